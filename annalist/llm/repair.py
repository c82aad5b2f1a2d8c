"""Conversations damaged on purpose, and the cheapest edits that make their turns alternate again.

Turns are sorted over the cluster and cut into segments; a long conversation has several.  DuckDB takes a batch of segments at
a time: each step of its recursion advances every segment by one turn and keeps, for each state of the grammar it may have
begun in and may now be in, the least cost and the least audit.  A second recursion puts the segments of a conversation
together, so that no task holds more of one conversation's turns than a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import lean, partitions, prepare, stored

#: Distinct turns in a segment, and in a batch of segments for DuckDB.
SEGMENT, BATCH = 2048, 100_000
#: What edits cost; an undeleted truncated turn adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar of role initials, (s?(ua)+)?: what a state accepts, and where that leads.  0 is the start, 1 after s, 2 after u, 3
#: after a; a conversation ends in 0 or 3.  Inserted and changed roles are user or assistant.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
BLANKS = "\\x20\\x09-\\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n: rows after damage by the checksum of ``conv_id:turn``, a null being one space; equal
    ones are one row that counts n times."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced[2]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced[3], "[.!?]", "")).otherwise(spaced[3]).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("n"),
        kind.alias("kind"),
    )
    return rows.where("kind <> 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def numbered(segment: int):
    """Sorted rows of a partition with their segment (in the order of all segments) and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, pos, now = TaskContext.get().partitionId() << 32, -1, segment, object()
        for batch in batches:
            seg, at = [], []
            for conv in batch.column(0).to_pylist():
                if conv != now or pos == segment:
                    now, k, pos = conv, k + 1, 0
                seg.append(base + k)
                at.append(pos)
                pos += 1
            yield pa.record_batch([pa.array(seg, pa.int64()), pa.array(at, pa.int64()), *batch.columns], names=["seg", "pos", *batch.schema.names])

    return lean(run)


def segmented(rows: DataFrame, segment: int) -> DataFrame:
    """Rows in the order of (conv_id, turn, role, text), nulls first, as a table with their segments."""
    n = partitions(rows.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = "seg long, pos long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored(ranged.mapInArrow(numbered(segment), schema), "turns")


def judged(turns: DataFrame) -> DataFrame:
    """seg, pos, conv_id, turn, n, initial, blank, repeats (copies that must go), truncated: without the texts.

    The first place of each role and text is found by aggregation and joined by that place, so a text that a conversation says
    over and over is no hot key.
    """
    hashes = (F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text")))
    rows = turns.select(
        "seg", "pos", "conv_id", "turn", "n", "role",
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"),
        (~F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")).alias("open"),
        hashes[0].alias("h1"), hashes[1].alias("h2"),
    )
    firsts = rows.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("seg", "pos")).alias("first")).select("first.seg", "first.pos", F.lit(True).alias("fresh"))
    rows = rows.join(firsts, ["seg", "pos"], "left")
    forced = F.when(F.col("blank") | F.col("fresh").isNull(), F.col("n")).otherwise(F.col("n") - 1)
    free = forced < F.col("n")
    return rows.select("seg", "pos", "conv_id", "turn", "n", "initial", "blank", forced.alias("forced"), free.alias("free"), (free & F.col("open")).alias("truncated"))


def moves() -> list[tuple]:
    """(from, initial, free, truncated, to, cost, audit): the best way to take one turn, with what is inserted before it."""
    best: dict[tuple, tuple] = {}
    for p in NEXT:
        paths, q, cost, audit = [(p, 0, "")], p, 0, ""
        while len(paths) < len(NEXT):
            q, cost, audit = next(t for x, t in NEXT[q].items() if x in ROLES), cost + INSERT, audit + "I"
            paths.append((q, cost, audit))
        for q, cost, audit in paths:
            for initial in ("s", "u", "a", ""):
                for free in (False, True):
                    for truncated in (False, True):
                        ways = []
                        if free:
                            ways += [(q, cost + DELETE, audit + "D"), *((t, cost + KEEP + TRUNCATED * truncated, audit + "K") for x, t in NEXT[q].items() if x == initial), *((t, cost + REROLE + TRUNCATED * truncated, audit + "R") for x, t in NEXT[q].items() if x in ROLES)]
                        else:  # all copies must go; the caller adds them
                            ways.append((q, cost, audit))
                        for t, c, a in ways:
                            key = (p, initial, free, truncated, t)
                            best[key] = min(best.get(key, (c, a)), (c, a))
    return [(*key, *value) for key, value in best.items()]


def endings() -> list[tuple[int, int, str]]:
    """(state, cost, audit) of what is inserted at the end."""
    out = []
    for p in NEXT:
        q, cost, audit = p, 0, ""
        while q not in ENDS:
            q, cost, audit = next(t for x, t in NEXT[q].items() if x in ROLES), cost + INSERT, audit + "I"
        out.append((p, cost, audit))
    return out


#: Advances all segments by a turn: first those that begin a conversation, from the start alone, the others from every state.
BY_TURN = f"""
with recursive way(seg, p, q, pos, cost, audit) using key (seg, p, q) as (
  select seg, p, p, -1::bigint, 0::bigint, '' from (select distinct seg, opening from turns) s, range(4) r(p) where p = 0 or not opening
  union
  select w.seg, w.p, m.q, t.pos, min(w.cost + m.cost + t.forced * {DELETE}),
         arg_min(w.audit || m.audit || repeat('D', t.forced), struct_pack(c := w.cost + m.cost, a := w.audit || m.audit || repeat('D', t.forced)))
  from way w join turns t on t.seg = w.seg and t.pos = w.pos + 1
  join moves m on m.p = w.q and m.initial = t.initial and m.free = t.free and m.truncated = t.truncated
  group by w.seg, w.p, m.q, t.pos)
select w.seg, w.p::int as p, w.q::int as q, w.cost, w.audit from way w join (select seg, max(pos) as pos from turns group by seg) n on n.seg = w.seg and n.pos = w.pos
"""

#: Advances all conversations by a segment.
BY_SEGMENT = """
with recursive way(conv, q, k, cost, audit, path) using key (conv, q) as (
  select distinct conv, 0, 0::bigint, 0::bigint, '', '0' from parts
  union
  select w.conv, s.q, s.k, min(w.cost + s.cost), arg_min(w.audit || s.audit, struct_pack(c := w.cost + s.cost, a := w.audit || s.audit)),
         arg_min(w.path || s.q, struct_pack(c := w.cost + s.cost, a := w.audit || s.audit))
  from way w join parts s on s.conv = w.conv and s.k = w.k + 1 and s.p = w.q
  group by w.conv, s.q, s.k)
select w.conv, min(w.cost + e.cost) as cost, arg_min(w.audit || e.audit, struct_pack(c := w.cost + e.cost, a := w.audit || e.audit)) as audit,
       arg_min(w.path, struct_pack(c := w.cost + e.cost, a := w.audit || e.audit)) as path
from way w join (select conv, max(k) as k from parts group by conv) n on n.conv = w.conv and n.k = w.k join endings e on e.p = w.q
group by w.conv
"""


def recursions(table: str, key: str, sql: str):
    """Batches sorted by ``key``, some whole keys at a time, through a recursive query over ``table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        con.execute("create table moves (p int, initial varchar, free boolean, truncated boolean, q int, cost bigint, audit varchar)")
        con.executemany("insert into moves values (?, ?, ?, ?, ?, ?, ?)", moves())
        con.execute("create table endings (p int, cost bigint, audit varchar)")
        con.executemany("insert into endings values (?, ?, ?)", endings())

        def answered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register(table, rows)
            yield from con.execute(sql).to_arrow_table().to_batches()
            con.unregister(table)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH:
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = rows.column(key)
                cut = rows.num_rows - 1
                last = keys[cut].as_py()
                while cut > 0 and keys[cut - 1].as_py() == last:
                    cut -= 1
                if cut:
                    yield from answered(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from answered(pa.Table.from_batches(held).combine_chunks())
        con.close()

    return lean(run)


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns (seg, pos, conv_id, role, text, n) of segments, each after a row at pos -1 whose text says what becomes of them and
    whose role is the state in which they begin, to repaired turns (conv_id, seg, at, role, text)."""
    now, of, letters, used, state, at = None, None, "", 0, 0, 0
    out: list[tuple] = []

    def edited(role: str, text: str, until: int) -> None:
        """The next letters, with the inserted turns before them, until so many turns are read (-1: to the end)."""
        nonlocal used, state, at
        while until and used < len(letters):
            c = letters[used]
            used += 1
            until -= c != "I"
            if c != "D":
                initial = role[:1] if c == "K" else next(x for x in NEXT[state] if x in ROLES)
                state = NEXT[state][initial]
                out.append((of, now, at, role if c == "K" else ROLES[initial], "" if c == "I" else text))
                at += 1

    def batch_of(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        out.clear()
        kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "seg", "at", "role", "text"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(2).type
        for seg, pos, conv, role, text, n in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if pos < 0:
                edited("", "", -1)
                now, of, letters, used, state, at = seg, conv, text, 0, int(role), 0
            else:
                edited(role, text, n)
        yield batch_of(kind)
    edited("", "", -1)
    yield batch_of(kind)


def repair(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The damaged ``conversations`` (conv_id, turn, role, text) and their repair: a row per conversation, and repaired turns.

    The first frame has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit for each conversation that has rows
    left after damage; the second conv_id, seg, at, role and text, in the order of (seg, at) within a conversation.

    A null role or text is one space, a null turn comes first, a null conv_id is one conversation.  Rows of one turn go by role,
    then by text; equal rows stay, as duplicates.  Roles are told by their first letter, in this case.  Gaps beyond 64 bits are
    null.  Other columns are not read.  No rows give no rows.
    """
    spark = conversations.sparkSession
    prepare(spark)
    n = partitions(spark)
    turns = segmented(damaged(conversations), segment)
    grammar = F.when(F.col("initial").isin(*NEXT[0], *ROLES), F.col("initial")).otherwise("")
    by_seg = Window.partitionBy("seg").orderBy("pos")
    rows = stored(judged(turns).withColumn("initial", grammar).withColumn("before", F.lag("initial").over(by_seg)), "judged")

    first, last = (f("initial", "pos") for f in (F.min_by, F.max_by))
    legal = F.concat("before", "initial").isin(*(x + y for x in ("s", "u", "a") for y in NEXT[NEXT[0].get(x, 3)]))
    segments = rows.groupBy("seg").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("forced"))).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.sum(F.col("n") - 1 + (F.col("before").isNotNull() & ~legal).cast("long")).alias("illegal"),
        first.alias("initial"),
        last.alias("last"),
    )
    by_conv = Window.partitionBy("conv_id").orderBy("seg")
    whole = Window.partitionBy("conv_id")
    segments = segments.withColumns({"k": F.row_number().over(by_conv).cast("long"), "conv": F.min("seg").over(whole), "before": F.lag("last").over(by_conv)})
    segments = stored(segments.withColumn("illegal", F.col("illegal") + (F.col("before").isNotNull() & ~legal).cast("long")), "segments")

    own = rows.join(segments.select("seg", (F.col("k") == 1).alias("opening")), "seg").select("seg", "pos", "initial", "free", "truncated", "forced", "opening")
    schema = "seg long, p int, q int, cost long, audit string"
    ways = stored(own.repartition(n, "seg").sortWithinPartitions("seg", "pos").mapInArrow(recursions("turns", "seg", BY_TURN), schema), "ways")
    parts = ways.join(segments.select("seg", "conv", "k"), "seg").select("conv", "k", "p", "q", "cost", "audit")
    best = stored(parts.repartition(n, "conv").sortWithinPartitions("conv").mapInArrow(recursions("parts", "conv", BY_SEGMENT), "conv long, cost long, audit string, path string"), "repairs")

    distinct = damaged(conversations).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("turns"))
    gaps = distinct.select("conv_id", F.when(F.col("turns") == 0, 0).otherwise(F.try_add(F.try_subtract("high", "low"), 1 - F.col("turns"))).alias("gaps"))
    counts = segments.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal"))).join(best, "conv")
    found = counts.join(gaps.withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same")))
    found = found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    at = F.col("k").cast("int")
    taken = segments.join(best.select("conv", "path"), "conv").select("seg", "conv_id", F.col("path").substr(at, F.lit(1)).cast("int").alias("p"), F.col("path").substr(at + 1, F.lit(1)).cast("int").alias("q"), (F.length("path") == at + 1).alias("ends"))
    tails = F.create_map(*(F.lit(x) for q, _, audit in endings() for x in (q, audit)))
    heads = taken.join(ways, ["seg", "p", "q"]).select("seg", F.lit(-1).cast("long").alias("pos"), "conv_id", F.col("p").cast("string").alias("role"), F.concat("audit", F.when(F.col("ends"), F.element_at(tails, F.col("q"))).otherwise("")).alias("text"), F.lit(0).cast("long").alias("n"))
    edited = turns.select("seg", "pos", "conv_id", "role", "text", "n").unionByName(heads).repartition(n, "seg").sortWithinPartitions("seg", "pos")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return found, edited.mapInArrow(lean(applied), f"conv_id {kind}, seg long, at long, role string, text string")


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to (conv_id, sha256 of ``role:text`` lines): a running hash, so a long conversation is never held."""
    now, running = None, None
    for batch in batches:
        convs, shas = [], []
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
            line = f"{role}:{text}".encode()
            if running is None or conv != now:
                if running is not None:
                    convs.append(now)
                    shas.append(running.hexdigest())
                now, running = conv, hashlib.sha256(line)
            else:
                running.update(b"\n" + line)
        yield pa.record_batch([pa.array(convs, batch.schema.field(0).type), pa.array(shas, pa.string())], names=["same", "repaired_sha256"])
    if running is not None:
        yield pa.record_batch([pa.array([now], batch.schema.field(0).type), pa.array([running.hexdigest()])], names=["same", "repaired_sha256"])


def repair_digest(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per original conv_id: repair()'s first frame, and the sha256 of the repaired ``role:text`` lines; zeros, an empty
    audit and the empty string's hash where no row is left."""
    found, turns = repair(conversations, segment)
    kind = turns.schema["conv_id"].dataType.simpleString()
    shas = turns.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seg", "at").mapInArrow(lean(hashed), f"same {kind}, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("same")), "left")
    zero = [F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
