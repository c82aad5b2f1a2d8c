"""How document filters interact: which removes what in every order, and which failures an earlier one hides.

Every document fails some of the filters; what matters of it is the mask of those.  Counts by mask are unpivoted against the
steps of all orders; running bit-ors along an order tell what has failed before, sums by filter the rest.  DataFrame only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters, by bit of the mask.
FILTERS = "ABCDE"
#: White space between words, for Java and for DuckDB.
SPACE = r"[ \t-\r]+"
#: Buckets over which rows without a doc_id are spread.
SPREAD = 64

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> Column:
    """Mask of A to D: what a text fails by itself."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = (
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per doc_id, part, text and mask: how many rows are so, and whether labels call the document good or toxic.

    Texts go no further than here; a hash of 256 bits and the length stand for them.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        own_failures(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("hash"),
        F.octet_length(text).alias("size"),
    ).withColumn("bucket", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("hash", "part"), F.lit(SPREAD))).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    ).withColumn("bucket", F.lit(0).cast("long"))
    joined = rows.join(known, ["doc_id", "bucket"], "left").fillna(0, ["good", "toxic"])
    return joined.groupBy("doc_id", "bucket", "part", "mask", "hash", "size", "good", "toxic").agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of all five filters), n, n_good, n_toxic: documents by what they fail.

    A text's rows are counted by part and label before they meet, so that copies of one text are few rows; the smallest
    doc_id of all of them passes E.
    """
    of = ["hash", "size", "part", "mask", "good", "toxic"]
    texts = featured(docs, labels).groupBy(of).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("hash", "size"))
    texts = texts.withColumn("passing", F.col("unnamed") + F.when(first, F.col("n_least")).otherwise(0))
    duplicate = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + duplicate).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    split = texts.select("part", "good", "toxic", both.alias("c")).select("part", "c.mask", "c.n", "good", "toxic")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def interactions(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and the seven counts, from cells.

    A part has 32 cells at most, so its 600 steps make 19,200 rows: parts are dealt out once, whole.
    """
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))
    step = F.posexplode(F.split("filter_order", ""))
    bits = F.create_map(*(F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)))
    long = (
        cells.repartition("part")
        .withColumn("filter_order", orders)
        .select("*", step.alias("at", "filter"))
        .withColumn("bit", F.element_at(bits, F.col("filter")))
        .withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    )
    along = Window.partitionBy("part", "mask", "filter_order").orderBy("at")
    before = F.coalesce(F.bit_or("hit").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.bit_or("hit").over(along.rowsBetween(Window.unboundedPreceding, 0))
    seen = long.withColumns({"before": before, "upto": upto})

    def total(condition: Column, n: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(n)).otherwise(0))

    hit, fresh = F.col("hit") != 0, F.col("before") == 0
    steps = seen.groupBy("part", "filter_order", "at", "filter").agg(
        total(F.col("upto") == 0).alias("kept"),
        total(hit & fresh).alias("removed"),
        total(hit & ~fresh).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(hit & fresh, "n_good").alias("good_lost"),
        total(hit & fresh, "n_toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), *COUNTS)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters interact on ``docs`` (doc_id, text, source), judged with ``labels`` (doc_id, quality, toxic).

    A: under 50 words; B: fewer than 65 % distinct words; C: over 5 % capitals A-Z; D: one of ``#$%&*|``; E: the text of a
    smaller doc_id of the whole table.  One row per part (source), order of the filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty (it fails A), a null source the empty part.  A row without a doc_id neither fails E nor makes
    others fail it, and has no label.  Repeated rows count each; those of the least doc_id all pass E.  A document is good
    or toxic if any of its label rows says so.  A part has all 600 rows, also if nothing fails; no documents, no rows.
    """
    return interactions(cells(docs, labels))


#: The same in DuckDB, by brute force over documents: every document walks every order.
ORACLE = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') as words from documents),
f as (
  select d.doc_id, part,
    len(words) < 50 as a,
    100 * len(list_distinct(words)) < 65 * len(words) as b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as dd,
    coalesce(doc_id > min(doc_id) over (partition by t), false) as e,
    coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic
  from d left join (select doc_id as id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1) l on l.id = d.doc_id),
k as (
  select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when dd then 'D' else '' end, case when e then 'E' else '' end) as fails,
         count(*) as n, sum(good) as n_good, sum(toxic) as n_toxic from f group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, s::int as step, filter_order[s] as x, filter_order[1:s - 1] as earlier from orders, range(1, 6) r(s)),
m as (
  select part, filter_order, step, x, n, n_good, n_toxic, contains(fails, x) as hit, fails = x as sole,
         len(list_filter(string_split(fails, ''), lambda y: y <> '' and contains(earlier, y))) > 0 as before
  from k, steps),
s as (
  select part, filter_order, step, x,
    coalesce(sum(n) filter (not hit and not before), 0) as kept, coalesce(sum(n) filter (hit and not before), 0) as removed,
    coalesce(sum(n) filter (hit and before), 0) as redundant, coalesce(sum(n) filter (sole), 0) as unique_fails,
    coalesce(sum(n_good) filter (hit and not before), 0) as good_lost, coalesce(sum(n_toxic) filter (hit and not before), 0) as toxic_lost
  from m group by 1, 2, 3, 4)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from s
"""
