"""The claim ledger: commands with guards folded to events and evidence, and views of them as of a time."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.fold import in_order

STATES = ("proposed", "adopted", "withdrawn", "superseded")
ANSWERS = "grp long, at long, rank int, claim_id long, op string, answer string, action string, replacement_id long, sequence long, evidence_id string, memory_id long, stance string, origin_id long"
VIEW = "id long, status string, decided long, latest long, supporting long, challenging long, origins long, unknown_origins long, issues long, redacted boolean"
#: A null where numbers are expected: no id or time; for times at which something ends, never.
NONE, NEVER = -(1 << 63), (1 << 63) - 1
#: What the fold reads of a command; null flags are no.
NULLS = {"grp": NONE, "at": NONE, "claim_id": NONE, "op": None, "evidence_id": None, "memory_id": NONE, "stance": None, "origin_id": NONE, "scope": None, "sensitive": False, "quoted": False, "gone_at": NEVER, "memory_sensitive": False, "corroborated": False, "stale_at": NEVER, "other_id": NONE}
Command = namedtuple("Command", NULLS)


def decoded(batch: pa.RecordBatch) -> Iterator[Command]:
    """The commands of a batch, taken out a column at a time: a value at a time costs more than the fold itself."""

    def values(name: str, null: object) -> list:
        column = batch.column(name)
        if null is not None:
            return pc.fill_null(column, null).to_numpy(zero_copy_only=False).tolist()
        if name == "evidence_id":
            return column.to_numpy(zero_copy_only=False).tolist()
        words = column.dictionary_encode()
        known = [*words.dictionary.to_pylist(), None]
        return [known[k] for k in pc.fill_null(words.indices, -1).to_numpy().tolist()]

    return map(Command._make, zip(*(values(*x) for x in NULLS.items()), strict=True))


@dataclass(slots=True)
class Claim:
    status: str
    scope: str
    sensitive: bool
    evidence: dict[str, Command] = field(default_factory=dict)  # accepted and not retracted
    retracted: dict[str, Command] = field(default_factory=dict)
    # for views: state and events as of a time; accepted evidence with its times
    shown: str = "proposed"
    decided: int | None = None
    latest: int | None = None
    cited: dict[str, list] = field(default_factory=dict)

    @property
    def ended(self) -> bool:
        return self.status in ("withdrawn", "superseded")


def hindrance(claim: Claim, at: int) -> str:
    """Why a claim can't be adopted; '' if it can."""
    if claim.ended:
        return "status"
    active = claim.evidence.values()
    if any(e.gone_at <= at for e in active) or any(e.gone_at <= at for e in claim.retracted.values()):
        return "redacted"  # a retracted citation may have shaped the claim too
    if any((claim.sensitive or e.memory_sensitive) and not e.corroborated for e in active):
        return "corroboration"
    if any(e.stale_at <= at for e in active):
        return "stale"
    return "" if any(e.stance == "supports" for e in active) else "support"


def step(claims: dict[int, Claim], c: Command) -> list[tuple]:
    """Answers to a command: text, action if it was accepted, claim, replacement."""
    claim, op, own = claims.get(c.claim_id), c.op, c.claim_id
    if op == "create":
        if claim is not None:
            return [("exists", None, own, None)]
        claims[own] = Claim("proposed", c.scope, c.sensitive)
        return [("proposed", "proposed", own, None)]
    if claim is None:
        return [("unknown_claim", None, own, None)]
    if op == "evidence":
        if claim.ended:
            return [("denied_status", None, own, None)]
        if c.gone_at <= c.at:
            return [("denied_forgotten", None, own, None)]
        if not c.quoted:
            return [("denied_quote", None, own, None)]
        if any(e.memory_id == c.memory_id and e.stance == c.stance for e in claim.evidence.values()):
            return [("same", None, own, None)]
        claim.retracted.pop(c.evidence_id, None)
        claim.evidence[c.evidence_id] = c
        return [("evidence_added", "evidence_added", own, None)]
    if op == "retract":
        if c.evidence_id in claim.retracted:
            return [("noop", None, own, None)]
        if c.evidence_id not in claim.evidence:
            return [("unknown_evidence", None, own, None)]
        claim.retracted[c.evidence_id] = claim.evidence.pop(c.evidence_id)
        return [("evidence_retracted", "evidence_retracted", own, None)]
    if op == "source_changed":
        if not claim.ended and any(e.memory_id == c.memory_id for e in claim.evidence.values()):
            return [("source_changed", "source_changed", own, None)]
        return [("none", None, own, None)]
    if op == "adopt":
        if why := hindrance(claim, c.at):
            return [(f"denied_{why}", None, own, None)]
        claim.status = "adopted"
        return [("adopted", "adopted", own, None)]
    if op == "withdraw":
        if claim.ended:
            return [("denied_status", None, own, None)]
        claim.status = "withdrawn"
        return [("withdrawn", "withdrawn", own, None)]
    if op != "revise":
        return []
    new = claims.get(c.other_id)
    if claim.status != "adopted":
        return [("denied_status", None, own, None)]
    if new is None or new.status != "proposed":
        return [("denied_replacement", None, own, None)]
    if new.scope != claim.scope:
        return [("denied_scope", None, own, None)]
    if why := hindrance(new, c.at):
        return [(f"denied_{why}", None, own, None)]
    new.status, claim.status = "adopted", "superseded"
    return [("adopted", "adopted", c.other_id, None), ("superseded", "superseded", own, c.other_id)]


def grouped(commands: DataFrame) -> DataFrame:
    """Commands by group, in their order."""
    return in_order(commands, "grp", ["at", "rank", "claim_id", "evidence_id"])


def ledger(commands: DataFrame, *fields: str) -> DataFrame:
    """Commands (grp, at, rank, claim_id, op, ...) to ANSWERS, all fields or some; accepted ones have an action and a sequence in their
    group.  Fields that nobody reads don't come back from Python.

    ``grp`` names claims that revisions may connect: a revision adopts one and supersedes another at once.
    """

    of_answers = dict(x.split() for x in ANSWERS.split(", "))
    names = fields or tuple(of_answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, claims, sequence = None, {}, 0
        for batch in batches:
            of, answers, actions, ids, others, places = [], [], [], [], [], []
            for i, c in enumerate(decoded(batch)):
                if c.grp != now:
                    now, claims, sequence = c.grp, {}, 0
                for answer, action, claim_id, other in step(claims, c):
                    sequence += action is not None
                    of.append(i)
                    answers.append(answer)
                    actions.append(action)
                    ids.append(claim_id)
                    others.append(other)
                    places.append(sequence if action else None)
            if of:
                taken = pa.array(of, pa.int64())
                made = {"claim_id": pa.array(ids, pa.int64()), "answer": pa.array(answers), "action": pa.array(actions, pa.string()), "replacement_id": pa.array(others, pa.int64()), "sequence": pa.array(places, pa.int64())}
                yield pa.record_batch([made[n] if n in made else batch.column(n).take(taken) for n in names], names=names)

    return grouped(commands).mapInArrow(run, ", ".join(f"{n} {of_answers[n]}" for n in names))


def noted(claims: dict[int, Claim], c: Command, action: str, claim_id: int, sequence: int, seen: bool) -> None:
    """An accepted command as views know it."""
    claim = claims[claim_id]
    if seen:
        claim.latest = sequence
        if action in STATES:
            claim.shown, claim.decided = action, sequence
    if action == "evidence_added":
        cited = claim.cited.setdefault(c.evidence_id, [c, c.stance, c.origin_id, c.at, None])
        if cited[0] is not c:  # once more after a retraction
            cited[:3] = max(cited[0], c, key=lambda x: x.memory_id), max(cited[1], c.stance), max(cited[2], c.origin_id)
    elif action == "evidence_retracted":
        cited = claim.cited[c.evidence_id]
        cited[4] = c.at if cited[4] is None else cited[4]


def summed(claim_id: int, claim: Claim, as_of: int) -> tuple:
    """VIEW row of a claim as of a time."""
    live = [(e, stance, origin) for e, stance, origin, recorded, retracted in claim.cited.values() if recorded <= as_of and (retracted is None or retracted > as_of)]
    pro = [origin for _, stance, origin in live if stance == "supports"]
    known = {x for x in pro if x != NONE}
    issues = sum(((claim.sensitive or e.memory_sensitive) and not e.corroborated) or e.stale_at != NEVER for e, _, _ in live)
    return claim_id, claim.shown, claim.decided, claim.latest, len(pro), sum(x[1] == "challenges" for x in live), len(known), pro.count(NONE), issues, any(x[0].gone_at != NEVER for x in claim.cited.values())


def view(claims: DataFrame, commands: DataFrame, as_of: int | None = None) -> DataFrame:
    """Claims (id, scope, sensitive, recorded_at) as of a recording time, under today's access to their sources, which the commands
    that cite them tell: gone_at (forgotten now, if not null), memory_sensitive, corroborated, stale_at (a review is overdue now, if
    not null).  A retraction recorded later is not known yet; text whose source is forgotten now is withheld, whatever was known
    then.  One replay gives state and evidence of each claim when its group ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    until, schema = NEVER if as_of is None else as_of, to_arrow_schema(StructType.fromDDL(VIEW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda out: pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        now, held, sequence = None, {}, 0
        for batch in batches:
            out = []
            for c in decoded(batch):
                if c.grp != now:
                    out += [summed(k, claim, until) for k, claim in held.items()]
                    now, held, sequence = c.grp, {}, 0
                for _, action, claim_id, _ in step(held, c):
                    if action:
                        sequence += 1
                        noted(held, c, action, claim_id, sequence, c.at <= until)
            if out:
                yield rows(out)
        if held:
            yield rows([summed(k, claim, until) for k, claim in held.items()])

    sums = grouped(commands).mapInArrow(run, VIEW)
    made = claims.where(F.lit(True) if as_of is None else F.col("recorded_at") <= as_of)
    out = made.join(sums, "id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("supporting", "challenging", "origins", "unknown_origins", "issues")}
    out = out.withColumns(counts | {"redacted": F.coalesce("redacted", F.lit(False)), "status": F.coalesce("status", F.lit("proposed"))})
    doubt = (F.col("latest") > F.col("decided")) | (F.col("issues") > 0) | (F.col("supporting") == 0)
    out = out.withColumn("review_required", F.col("redacted") | ((F.col("status") == "adopted") & doubt))
    return out.withColumn("eligible", (F.col("status") == "adopted") & ~F.col("review_required"))
