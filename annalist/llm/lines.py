"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog sketches, exact near the threshold.  DataFrame only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import free, stored

#: A line on this many sites is boilerplate.
SITES = 10
#: Sketch size (2 ** LG_K registers) and the share of the threshold within which estimates are not trusted.
LG_K = 11
MARGIN = 0.2
#: Parts into which the rows of a line are dealt before their sketches are merged.
PARTS = 64
#: Stands for a null doc_id: such rows come last.
LAST = (1 << 63) - 1


def row_key() -> tuple:
    """What names a row: its doc_id, and a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text", F.col("doc_id").isNull())


def lines_of(docs: DataFrame) -> DataFrame:
    """doc and hash (of the row), source, pos and a 128-bit hash of every line that isn't blank; a line counts without outer
    spaces."""
    doc, text = row_key()
    lines = docs.select(doc.alias("doc"), text.alias("hash"), F.col("source").cast("string").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    return lines.where(F.length(line) > 0).select("doc", "hash", "source", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes (h1, h2) of lines on at least ``sites`` distinct sources, and the first place (doc, pos, hash) of each.

    Only lines with that many rows and two sources can qualify; their sources go into sketches that merge by aggregation.
    Estimates near the threshold are replaced by exact counts.  A null source is no site.
    """
    seen = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("source").alias("x"), F.max("source").alias("y"), F.min(F.struct("doc", "pos", "hash")).alias("first"))
    often = stored(seen.where((F.col("n") >= sites) & ((F.col("x") != F.col("y")) | F.lit(sites <= 1)) & F.col("x").isNotNull()).select("h1", "h2", "first"), "often")
    # a common line is no single task's work: its rows are dealt by part, too, and their sketches merged
    dealt = often.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    rows = lines.where("source is not null").select("h1", "h2", "source", F.pmod(F.xxhash64("doc", "hash"), F.lit(PARTS)).cast("int").alias("part")).join(dealt, ["h1", "h2", "part"])
    sketches = rows.groupBy("h1", "h2", "part").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch"))
    spread = stored(sketches.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites")), "spread")
    close = spread.where(F.abs(F.col("sites") - sites) <= MARGIN * sites + 1).select("h1", "h2")
    near = close.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    exact = rows.join(near, ["h1", "h2", "part"]).select("h1", "h2", "part", "source").distinct().select("h1", "h2", "source").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    return spread.join(exact, ["h1", "h2"], "left").where(F.coalesce("exact", "sites") >= sites).join(often, ["h1", "h2"]).select("h1", "h2", "first")


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that dedup_lines() adds: n_lines and n_removed, with underscores where docs has such a column."""
    return free("n_lines", docs.columns), free("n_removed", docs.columns)


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) with boilerplate lines cut from text, all rows and columns kept, and
    ``n_lines``, ``n_removed`` (long); see count_names() where docs has columns of these names, which stay as they are.

    Of each boilerplate line the first place (least doc_id, a null one last; then least line) stays.  Blank lines, null and
    empty texts are as they were (n_lines counts the pieces between line feeds; 0 for null).  Rows that repeat a doc_id and
    a text lose the same lines; rows of one doc_id with other texts are rows of their own.  An empty table stays empty.
    """
    n_lines, n_removed = count_names(docs)
    doc, text_hash, gone_at = (free(n, [*docs.columns, n_lines, n_removed]) for n in ("doc", "hash", "gone"))
    lines = stored(lines_of(docs), "lines")
    bad = stored(boilerplate(lines, sites), "boilerplate")
    place = F.struct("doc", "pos", "hash")
    gone = lines.join(bad, ["h1", "h2"]).where(place != F.col("first")).select(F.col("doc").alias(doc), F.col("hash").alias(text_hash), "pos")
    # at most as many numbers as the document has lines
    gone = gone.groupBy(doc, text_hash).agg(F.collect_set("pos").alias(gone_at))
    own_doc, own_hash = row_key()
    out = docs.join(gone, (own_doc == F.col(doc)) & (own_hash == F.col(text_hash)), "left")
    pieces = F.split("text", "\n", -1)
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(F.col(gone_at), i))
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counts = {n_lines: F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long"), n_removed: F.coalesce(F.size(gone_at), F.lit(0)).cast("long")}
    return out.withColumns({"text": text} | counts).drop(doc, text_hash, gone_at)


#: DuckDB SQL for the digest query: exact counts of sites.
ORACLE = f"""
with l as (select doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from documents where text is not null),
b as (select trim(line) as k, min((doc_id, pos)) as first from l where trim(line) <> '' group by 1 having count(distinct source) >= {SITES}),
m as (select l.doc_id, l.pos, l.line, b.k is not null and (l.doc_id, l.pos) <> b.first as gone from l left join b on trim(l.line) = b.k)
select d.doc_id, coalesce(count(m.pos), 0)::bigint as n_lines, coalesce(sum(m.gone::int), 0)::bigint as n_removed,
  md5(coalesce(string_agg(m.line, chr(10) order by m.pos) filter (where not m.gone), '')) as text_md5
from documents d left join m on d.doc_id = m.doc_id group by d.doc_id
"""
