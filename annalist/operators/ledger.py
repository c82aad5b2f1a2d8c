"""Bitemporal claims, memory lifecycle folds, provenance and narratives: event tables folded to states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.operators.ordered import following


def visible(as_of: int | None) -> Column:
    return F.lit(True) if as_of is None else F.col("recorded_at") <= as_of


def valid_at(moment: int) -> Column:
    """Half-open validity: valid_from <= moment < valid_until; an absent bound is open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= moment)) & (F.col("valid_until").isNull() | (F.lit(moment) < F.col("valid_until")))


def support(evidence: DataFrame, as_of: int | None) -> DataFrame:
    """Per claim what was recorded by ``as_of`` and not retracted by then: supporting and challenging records, distinct known
    origins and unknown ones of the supporting.  A retraction recorded later doesn't count yet."""
    gone = F.col("retracted_at").isNotNull() & (F.lit(True) if as_of is None else F.col("retracted_at") <= as_of)
    active = evidence.where(visible(as_of) & ~gone)
    pro = F.col("stance") == "supports"
    return active.groupBy("claim_id").agg(F.count_if(pro).alias("supporting"), F.count_if(F.col("stance") == "challenges").alias("challenging"), F.count_distinct(F.when(pro, F.col("origin_id"))).alias("origins"), F.count_if(pro & F.col("origin_id").isNull()).alias("unknown_origins"))


def claim_view(claims: DataFrame, evidence: DataFrame, forgotten: DataFrame, as_of: int | None) -> DataFrame:
    """Claims with support, redaction (any source, of retracted evidence too, is forgotten now) and eligibility."""
    bad = evidence.join(forgotten, "memory_id", "left_semi").select(F.col("claim_id").alias("id")).distinct().withColumn("redacted", F.lit(True))
    sums = support(evidence, as_of).withColumnRenamed("claim_id", "id")
    view = claims.where(visible(as_of)).join(sums, "id", "left").join(bad, "id", "left")
    view = view.withColumn("redacted", F.coalesce("redacted", F.lit(False))).withColumn("supporting", F.coalesce("supporting", F.lit(0)))
    review = (F.col("status") == "adopted") & (F.col("redacted") | (F.col("supporting") == 0))
    return view.withColumn("review_required", review).withColumn("eligible", (F.col("status") == "adopted") & ~review & ~F.col("redacted"))


def provenance(commands: DataFrame) -> DataFrame:
    """Per memory: distinct labels of its corroborations, its origin (label of its first command), and how many corroborations
    are independent of that origin (one fewer, not below 0, if the origin is unknown)."""
    said = commands.where("op = 'corroborate' and trim(label) <> ''").groupBy("memory_id").agg(F.collect_set(F.trim("label")).alias("labels"))
    origin = commands.groupBy("memory_id").agg(F.min_by("label", "seq").alias("origin"))
    known = F.col("origin").isNotNull() & (F.trim("origin") != "")
    n = F.coalesce(F.size("labels"), F.lit(0))
    own = F.coalesce(F.array_contains("labels", F.trim("origin")).cast("int"), F.lit(0))
    return origin.join(said, "memory_id", "left").select("memory_id", n.alias("labels"), F.when(known, n - own).otherwise(F.greatest(n - 1, F.lit(0))).alias("independent"))


def states(commands: DataFrame) -> DataFrame:
    """Commands folded to one row per memory: first promotion, last reason, last review, whether forgotten last."""
    is_ = lambda op: F.col("op") == op
    fold = commands.groupBy("memory_id").agg(F.min("moment").alias("created_at"), F.min(F.when(is_("promote"), F.col("moment"))).alias("consolidated_at"), F.max_by("label", F.when(is_("promote"), F.col("seq"))).alias("reason"), F.max(F.when(is_("review"), F.col("moment"))).alias("reviewed_at"), F.max(F.when(is_("forget"), F.col("seq"))).alias("forgot"), F.max(F.when(is_("remember") | is_("promote"), F.col("seq"))).alias("revived"))
    status = F.when(F.col("consolidated_at").isNull(), "working").otherwise("consolidated")
    return fold.select("memory_id", "created_at", "consolidated_at", "reason", "reviewed_at", status.alias("status"), F.coalesce(F.col("forgot") > F.coalesce("revived", F.lit(-1)), F.lit(False)).alias("forgotten"))


def guarded(commands: DataFrame) -> DataFrame:
    """Every 'promote' after a first one asks to pin: it is accepted if, before it, the memory was consolidated, not forgotten
    and, if it is ``sensitive``, corroborated; the answer depends on state before the command only."""
    before = W.partitionBy("memory_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    had = lambda op: F.coalesce(F.max(F.when(F.col("op") == op, F.col("seq"))).over(before), F.lit(-1))
    asked = commands.withColumns({"promoted": had("promote"), "forgot": had("forget"), "said": had("corroborate")}).where("op = 'promote' and promoted >= 0")
    answer = F.when(F.col("forgot") > F.col("promoted"), "denied_forgotten").when(F.col("sensitive") & (F.col("said") < 0), "denied_uncorroborated").otherwise("pinned")
    return asked.select("seq", "memory_id", answer.alias("answer"))


def chained(versions: DataFrame) -> DataFrame:
    """Narrative versions (id, scope, created_at): each is superseded by the next of its scope."""
    return following(versions, "scope", ["created_at", "id"], {"superseded_by": "id", "superseded_at": "created_at"}, width=7 * 86400)


def invalidated(narratives: DataFrame, sources: DataFrame, changes: DataFrame) -> DataFrame:
    """First change (memory_id, moment, op) of a source after a narrative (id, reviewed_at) was last reviewed."""
    hit = narratives.join(sources, "id").join(changes, "memory_id").where(F.col("moment") > F.col("reviewed_at"))
    return hit.groupBy("id").agg(F.min("moment").alias("stale_at"), F.min_by("op", F.struct("moment", "seq")).alias("because"))
