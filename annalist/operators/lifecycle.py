"""The life of a memory: commands with guards, each answered by audit actions, folded to states."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.fold import folded, replayed

#: What is known of a memory.
STATE = "known boolean, created_at long, tier string, status string, consolidated_at long, reason string, pinned_at long, forgotten_at long, sensitive boolean, origin_known boolean, independent int, canon array<struct<scope: string, at: long>>, reviewed_at long, frame string"
#: What replay() returns: the command, its audit actions joined by '+', and the memory's state after it.
AUDIT = f"seq long, memory_id long, moment long, op string, action string, detail string, {STATE}"


@dataclass
class Memory:
    known: bool = False
    tier: str = "archive"
    status: str = "working"
    source: str | None = None
    sensitive: bool = False
    created_at: int | None = None
    consolidated_at: int | None = None
    reason: str | None = None
    pinned_at: int | None = None
    forgotten_at: int | None = None
    reviewed_at: int | None = None
    frame: str | None = None
    voices: set[str] = field(default_factory=set)
    canon: dict[str, int] = field(default_factory=dict)

    @property
    def independent(self) -> int:
        """Corroborating voices that can't be the origin; with an unknown origin one of them might be."""
        origin = (self.source or "").strip()
        return len(self.voices - {origin}) if origin else max(len(self.voices) - 1, 0)

    @property
    def doubtful(self) -> bool:
        return self.sensitive and self.independent < 1


def remember(m: Memory, c: dict) -> list[str]:
    if m.known:
        return ["exists"]
    if c["tier"] == "testimony":  # only corroboration makes testimony
        return ["testimony_refused"]
    m.known, m.tier, m.source, m.sensitive = True, c["tier"], c["source"], bool(c["sensitive"])
    m.created_at = c["moment"]
    m.reviewed_at = c["moment"] if m.tier == "interpretation" else None
    return ["remember"]


def promote(m: Memory, c: dict) -> list[str]:
    if m.status != "consolidated":
        m.status, m.consolidated_at = "consolidated", c["moment"]
    m.reason = c["label"]
    return ["promote"]


def entering(m: Memory, denied: str) -> list[str]:
    """Why a memory may not become an anchor or canon."""
    if m.forgotten_at is not None:
        return ["is_forgotten"]
    if m.status != "consolidated":
        return ["not_consolidated"]
    return [denied] if m.doubtful else []


def pin(m: Memory, c: dict) -> list[str]:
    if why := entering(m, "pin_denied"):
        return why
    m.pinned_at = c["moment"]
    return ["pin"]


def unpin(m: Memory, c: dict) -> list[str]:
    was, m.pinned_at = m.pinned_at, None
    return ["unpin" if was is not None else "unpin_noop"]


def forget(m: Memory, c: dict) -> list[str]:
    if m.pinned_at is not None:
        return ["is_anchored"]
    if m.canon:
        return ["is_canon"]
    m.forgotten_at = c["moment"] if m.forgotten_at is None else m.forgotten_at
    return ["forget"]


def restore(m: Memory, c: dict) -> list[str]:
    if m.forgotten_at is None:
        return ["not_forgotten"]
    m.forgotten_at = None
    return ["restore"]


def corroborate(m: Memory, c: dict) -> list[str]:
    if not (c["label"] or "").strip():
        return ["blank_source"]
    m.voices.add(c["label"].strip())
    if m.tier == "archive" and m.independent > 0:
        m.tier = "testimony"
        return ["corroborate", "corroborate_upgrade"]
    return ["corroborate"]


def review(m: Memory, c: dict) -> list[str]:
    if m.tier != "interpretation":
        return ["not_interpretation"]
    m.reviewed_at = c["moment"]
    return ["review"]


def flag(m: Memory, c: dict) -> list[str]:
    m.sensitive, out = True, ["flag_sensitive"]
    if m.doubtful and m.pinned_at is not None:
        m.pinned_at = None
        out.append("unpin_by_sensitivity")
    if m.doubtful and m.canon:
        m.canon.clear()
        out.append("decanonize_by_sensitivity")
    return out


def canonize(m: Memory, c: dict) -> list[str]:
    if why := entering(m, "canonize_denied"):
        return why
    if c["scope"] in m.canon:
        return ["in_canon"]
    m.canon[c["scope"]] = c["moment"]
    return ["canonize"]


def decanonize(m: Memory, c: dict) -> list[str]:
    """One scope, or all without a scope."""
    gone = [s for s in m.canon if c["scope"] in (None, s)]
    for s in gone:
        del m.canon[s]
    return ["decanonize" if gone else "not_canon"]


def end_scope(m: Memory, c: dict) -> list[str]:
    return ["end_scope"] if m.canon.pop(c["scope"], None) is not None else []


def set_frame(m: Memory, c: dict) -> list[str]:
    m.frame = c["label"]
    return ["set_frame"]


COMMANDS = {f.__name__: f for f in (remember, promote, pin, unpin, forget, restore, corroborate, review, flag, canonize, decanonize, end_scope, set_frame)}


def answered(m: Memory, c: dict) -> list[str]:
    """The audit actions of a command, which changes the memory."""
    return COMMANDS[c["op"]](m, c) if m.known or c["op"] == "remember" else ["unknown_memory"] * (c["op"] != "end_scope")


def state(m: Memory) -> dict:
    """STATE of a memory."""
    canon = [{"scope": s, "at": at} for s, at in m.canon.items()]
    return {k: getattr(m, k) for k in "known created_at tier status consolidated_at reason pinned_at forgotten_at sensitive independent reviewed_at frame".split()} | {"origin_known": bool((m.source or "").strip()), "canon": canon}


def step(m: Memory, c: dict) -> list[dict]:
    actions = answered(m, c)
    if not actions:
        return []
    return [{k: c[k] for k in ("seq", "memory_id", "moment", "op")} | {"action": "+".join(actions), "detail": c["scope"] or c["label"]} | state(m)]


def with_ends(commands: DataFrame) -> DataFrame:
    """Commands with the ends of scopes made commands of memories.

    The end of a scope names no memory.  It can only end what was asked for since the end before it, so each memory gets the
    first end after each time that it asked for the scope: no more ends than canonizations, however many memories and ends.
    """
    ends = first_after(commands.where("op = 'canonize'").select("scope", "seq", "memory_id"), commands.where("op = 'end_scope'").drop("memory_id"), "scope")
    return commands.where("op <> 'end_scope'").unionByName(ends.select("memory_id", "after.*").distinct().select(commands.columns))


def replay(commands: DataFrame) -> DataFrame:
    """Commands (seq, memory_id, moment, op, label, scope, source, tier, sensitive) to AUDIT rows."""
    return replayed(with_ends(commands), "memory_id", ["seq"], Memory, step, AUDIT)


def last_states(commands: DataFrame) -> DataFrame:
    """The state of every known memory (memory_id, STATE) after its last command; none of those before leaves the replay."""
    return folded(with_ends(commands), "memory_id", ["seq"], Memory, answered, lambda k, m: [{"memory_id": k} | state(m)] if m.known else [], f"memory_id long, {STATE}")


#: Numbers in a row that the join by time takes as one block.
BLOCK = 4096


def first_after(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """rows (key, seq, ...) with ``after``: the first of ``marks`` (key, seq, ...) with a greater seq; rows without one go.

    A join by time in blocks of seq: within a block by a window over the block, else by the first mark of the next block that
    has one, which a window over blocks finds.  So a key with most rows is many groups.
    """
    block = F.floor(F.col("seq") / BLOCK)
    mark = F.struct("seq", *(c for c in marks.columns if c not in ("seq",)))
    both = rows.withColumn("mark", F.lit(None).cast(marks.select(mark).schema[0].dataType)).unionByName(marks.select(key, "seq", mark.alias("mark")), allowMissingColumns=True).withColumn("block", block)
    inside = Window.partitionBy(key, "block").orderBy(F.desc("seq"), F.col("mark").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("mark", ignorenulls=True).over(inside)).where("mark is null")
    blocks = both.groupBy(key, "block").agg(F.min("mark").alias("own"))
    later = Window.partitionBy(key).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("far", F.last("own", ignorenulls=True).over(later)).select(key, "block", "far")
    found = near.join(blocks, [key, "block"], "left").withColumn("after", F.coalesce("near", "far"))
    return found.where("after is not null").select(*rows.columns, "after")


def alternating(commands: DataFrame, key: list[str], opens: str, closes: str) -> DataFrame:
    """Records of ``opens`` ... ``closes`` commands (seq, op) per key, in order: an open one is not opened again, a closed one not
    closed: opened, closed (null while open).  A command counts iff it differs from the one before it."""
    order = Window.partitionBy(*key).orderBy("seq")
    real = commands.withColumn("before", F.coalesce(F.lag("op").over(order), F.lit(closes))).where("op <> before").drop("before")
    real = real.withColumns({"closed": F.lead("seq").over(order), "closing": F.lead(F.struct(*[c for c in commands.columns if c not in key])).over(order)})
    return real.where(F.col("op") == opens).withColumnRenamed("seq", "opened")


def moved(contexts: DataFrame) -> DataFrame:
    """Context commands (seq, memory_id, event_at, session_id, position) with what they replace: before and after as JSON, changed,
    and refused where another memory has had the place in the session before; places stay taken."""
    place = Window.partitionBy("session_id", "position").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("memory_id").over(place)
    taken = F.col("position").isNotNull() & first.isNotNull() & (first != F.col("memory_id"))
    ok = contexts.withColumn("refused", taken)
    now = F.struct("event_at", "session_id", "position")
    order = Window.partitionBy("memory_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~F.col("refused"), now), ignorenulls=True).over(order)
    ok = ok.withColumns({"before": before, "after": now})
    return ok.select("seq", "memory_id", "refused", F.to_json("before").alias("before"), F.to_json("after").alias("after"), (~F.col("refused") & ~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))
