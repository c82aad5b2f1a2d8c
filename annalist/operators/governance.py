"""Versions and contradictions between statements, and their effect on a window of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.functions import vocab as V


def profile(c: Column) -> dict[str, Column]:
    """All that pairwise rules read of a statement."""
    return {"tokens": F.array_distinct(T.tokens(c)), "stems": T.stems(c), "words": T.content_words(c), "letters": F.array_distinct(F.split(c, "")), "domain": T.domain(c), "pronoun": T.pronoun(c), "changed": T.changed(c), "revoked": T.revoked(c), "negated": T.negated(c), "latin": T.latin(c), "triple": T.triple_key(c), "key": T.normal(c), "n_chars": F.length(c)}


def dealt(rows: DataFrame, user: str) -> DataFrame:
    """Rows dealt out by user over as many tasks as shuffles have: a table is a few files, and one task reads each of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), user)


def profiled(rows: DataFrame) -> DataFrame:
    """Rows with their profiles, computed once per row."""
    return rows.withColumns(profile(F.col("content")))


def pairs(rows: DataFrame, user: str, recent: int = 300) -> DataFrame:
    """(old, new) structs of rows of one user, new among the ``recent`` that follow old in (moment, position, id) order.

    The join is an equi-join on the user and blocks of ``recent`` places, so it is linear in the rows.
    """
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(user).orderBy("moment", "position", "id"))).withColumn("block", F.floor(F.col("place") / recent))
    names = placed.columns
    old = placed.select(F.col(user).alias("u"), F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), F.struct(*names).alias("old"))
    new = placed.select(F.col(user).alias("u"), "block", F.struct(*names).alias("new"))
    return old.join(new, ["u", "block"]).where((F.col("old.place") < F.col("new.place")) & (F.col("new.place") - F.col("old.place") <= recent)).select("old", "new")


def shared(kind: str) -> Column:
    return F.size(F.array_intersect(f"old.{kind}", f"new.{kind}"))


def same_domain() -> Column:
    """Both state a fact of one domain about a shared subject, and one of them says that it changed."""
    subject = (shared("tokens") > 0) | (shared("words") > 0) | (F.col("old.pronoun") == F.col("new.pronoun"))
    ages = (F.col("new.domain") == "identity") & F.col("old.content").contains("岁") & F.col("new.content").contains("岁")
    return F.coalesce((F.col("old.domain") == F.col("new.domain")) & (F.col("old.changed") | F.col("new.changed") | ages) & subject, F.lit(False))


def overlap() -> tuple[Column, Column]:
    """Jaccard similarity of the token sets, and the share of the old one's tokens that the new one has."""
    some = (F.size("old.tokens") > 0) & (F.size("new.tokens") > 0)
    return F.when(some, shared("tokens") / F.size(F.array_union("old.tokens", "new.tokens"))).otherwise(0.0), F.when(some, shared("tokens") / F.size("old.tokens")).otherwise(0.0)


def rewrite(jaccard: Column) -> Column:
    """The new text is clearly longer and contains the old one's tokens, or is nearly the same."""
    contained = F.size(F.array_except("old.tokens", "new.tokens")) == 0
    fact = (F.size("old.tokens") >= 3) | ((F.size("old.tokens") >= 2) & F.col("new.changed"))
    return (F.col("new.n_chars") >= V.LONGER * F.col("old.n_chars")) & F.when(contained, fact).otherwise(jaccard >= V.STRONG_JACCARD)


def versions(rows: DataFrame, user: str, recent: int = 300) -> DataFrame:
    """(old_id, new_id, similarity): the new statement replaces the old one."""
    return judged_versions(pairs(profiled(dealt(rows, user)), user, recent))


def judged_versions(found: DataFrame) -> DataFrame:
    """Which pairs (old, new) of profiled statements are versions.  Only a speaker revises their own facts, unless both are
    triples of one subject and relation."""
    jaccard, coverage = overlap()
    triple = F.coalesce(F.col("old.triple") == F.col("new.triple"), F.lit(False))
    other = F.coalesce(F.col("old.triple") != F.col("new.triple"), F.lit(False))
    domain = triple | (same_domain() & (F.col("old.n_chars") <= V.STATEMENT_CHARS) & (F.col("new.n_chars") <= V.STATEMENT_CHARS))
    found = found.where(((F.col("old.source") == F.col("new.source")) | triple) & (F.col("old.key") != F.col("new.key")) & ~other & (domain | rewrite(jaccard)) & (domain | (jaccard >= V.STRONG_JACCARD) | (coverage >= V.STRONG_COVERAGE)))
    return found.select(F.col("old.id").alias("old_id"), F.col("new.id").alias("new_id"), F.round(jaccard, 4).alias("similarity"))


def contradictions(rows: DataFrame, user: str, recent: int = 300) -> DataFrame:
    """(a, b, signal): statements of one speaker that contradict each other; both stay."""
    return judged_contradictions(pairs(profiled(dealt(rows, user)), user, recent))


def judged_contradictions(found: DataFrame) -> DataFrame:
    opposite = T.opposite(F.col("old.content"), F.col("new.content"))
    about = (F.col("old.domain") == F.col("new.domain")) & ~F.col("old.revoked") & ~F.col("new.revoked") & (shared("letters") >= 2)
    words = ~(F.col("old.latin") | F.col("new.latin")) | (shared("stems") >= 2) | opposite.isNotNull()
    short = (F.col("old.n_chars") <= V.STATEMENT_CHARS) & (F.col("new.n_chars") <= V.STATEMENT_CHARS) & F.col("old.triple").isNull() & F.col("new.triple").isNull()
    signal = F.when(F.col("old.negated") != F.col("new.negated"), F.lit("negation_flip")).otherwise(opposite)
    found = found.where((F.col("old.source") == F.col("new.source")) & about & words & short)
    return found.select(F.col("old.id").alias("a"), F.col("new.id").alias("b"), signal.alias("signal")).where("signal is not null")


def governed(window: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """A result window (qid, id, source, content, moment, position, score, ...) without duplicates, older versions discounted.

    Of texts with one normal form the newest stays.  A statement that a later one of its speaker revises keeps a quarter of
    its score if they overlap strongly, else half; ``superseded`` (qid, id) keep a tenth.  No score stays none.
    """
    newest = F.row_number().over(W.partitionBy("qid", "key").orderBy(F.desc("moment"), F.desc("position"), F.desc("id")))
    rows = window.withColumn("key", T.normal(F.col("content"))).withColumn("n", newest).where("n = 1").drop("n", "key")
    jaccard, coverage = overlap()
    found = pairs(profiled(rows), "qid").where((F.col("old.source") == F.col("new.source")) & (same_domain() | rewrite(jaccard)))
    worst = found.groupBy(F.col("old.qid").alias("qid"), F.col("old.id").alias("id")).agg(F.max(jaccard).alias("j"), F.max(coverage).alias("c"))
    strong = (F.col("j") >= V.STRONG_JACCARD) | (F.col("c") >= V.STRONG_COVERAGE)
    factor = F.when((F.col("j") > 0) | (F.col("c") > 0), F.when(strong, V.STRONG_DISCOUNT).otherwise(V.WEAK_DISCOUNT)).otherwise(1.0)
    out = rows.join(worst, ["qid", "id"], "left").withColumn("score", F.round(F.col("score") * factor, 4))
    if superseded is not None:
        out = out.join(superseded.select("qid", "id", F.lit(True).alias("old")).distinct(), ["qid", "id"], "left").withColumn("score", F.when(F.col("old"), F.round(F.col("score") * V.SUPERSEDED_DISCOUNT, 4)).otherwise(F.col("score")))
    return out.select(*window.columns)
