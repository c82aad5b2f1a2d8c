"""Conversation repair against an exhaustive search over edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from annalist.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if BLANK.match(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every way to edit: what each row becomes, and up to two inserted turns at each place."""
    kinds = faults(rows)
    inserts = [list(itertools.chain.from_iterable(itertools.product("ua", repeat=n) for n in range(3)))] if len(rows) < 4 else [[(), ("u",), ("a",)]]
    best = None
    ops = [["D"] if k in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for k in kinds]
    for chosen in itertools.product(*ops):
        for added in itertools.product(*(inserts * (len(rows) + 1))):
            cost, audit, made = 0, "", []
            for k in range(len(rows) + 1):
                for x in added[k]:
                    cost, audit = cost + 2, audit + "I"
                    made.append(({"u": "user", "a": "assistant"}[x], ""))
                if k < len(rows):
                    op = chosen[k]
                    audit += op[0]
                    cost += {"D": 3, "K": 0, "R": 2}[op[0]] + (op != "D" and kinds[k] == "truncated")
                    if op != "D":
                        made.append((rows[k][2] if op == "K" else {"u": "user", "a": "assistant"}[op[1]], rows[k][3]))
            if best is not None and (cost, audit) > best[:2]:
                continue
            if GRAMMAR.match("".join(r[:1] or "-" for r, _ in made)):
                best = (cost, audit, made)
    return best


def walked(rows):
    """The same over longer conversations: states of the grammar, turn by turn, over whole lists."""
    following = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}

    def inserted(states):
        for _ in range(3):
            for q, (c, a, m) in list(states.items()):
                x = following[q][-1]
                way = (c + 2, a + "I", (*m, ({"u": "user", "a": "assistant"}[x], "")))
                if x not in states or way[:2] < states[x][:2]:
                    states[x] = way
        return states

    for (_, _, role, text), kind in zip(rows, faults(rows)):
        new = {}
        for q, (c, a, m) in inserted(dict(states)).items():
            ways = [(q, (c + 3, a + "D", m))]
            if kind not in ("blank", "duplicate"):
                t = kind == "truncated"
                if role[:1] and role[:1] in following[q]:
                    ways.append((role[0], (c + t, a + "K", (*m, (role, text)))))
                x = following[q][-1]
                ways.append((x, (c + 2 + t, a + "R", (*m, ({"u": "user", "a": "assistant"}[x], text)))))
            for x, way in ways:
                if x not in new or way[:2] < new[x][:2]:
                    new[x] = way
        states = new
    done = inserted(dict(states))
    return min((done[q] for q in ("", "a") if q in done), key=lambda w: w[:2])


def expected(rows, solve):
    out = {}
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    for conv, own in groups.items():
        own = sorted(damage(own), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = sorted({r[1] for r in own if r[1] is not None})
        kinds = faults(own)
        initials = [r[2][:1] for r in own]
        cost, audit, made = solve(own)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(frame):
    return {r["conv_id"]: tuple(r[c] for c in "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()) for r in frame.collect()}


def random_rows(seed, convs, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "So it is!  ", "One. Two", "x" * 50 + "."]
    return [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(texts)) for c in range(convs) for t in r.sample(range(2 * longest), r.randint(1, longest))]


def test_short_conversations_against_all_edits(spark):
    rows = random_rows(1, 120, 4)
    assert got(repair.repair_digest(spark.createDataFrame(rows, SCHEMA))) == expected(rows, cheapest)


def test_walk_equals_all_edits():
    """The walk that longer conversations are held against finds what the exhaustive search finds."""
    for own in itertools.groupby(random_rows(2, 150, 4), key=lambda r: r[0]):
        own = list(own[1])
        a, b = cheapest(own), walked(own)
        assert (a[0], a[1], list(a[2])) == (b[0], b[1], list(b[2]))


@pytest.mark.parametrize("segment", [1, 3, 7, 2048])
def test_long_conversations_in_segments(spark, segment):
    rows = random_rows(3, 12, 40) + [(99, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 90}.") for t in range(300)]
    assert got(repair.repair_digest(spark.createDataFrame(rows, SCHEMA), segment)) == expected(rows, walked)


def test_awkward_rows(spark):
    """Nulls anywhere, ties, repeated rows, a conversation that loses all rows, clashing names."""
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (None, None, "assistant", "Yes."), (None, 1, "assistant", "Yes."), (7, 2, "user", "Same."), (7, 2, "user", "Same."), (7, 2, "assistant", "Same."), (7, None, "system", "Be good."), (8, None, "user", "A."), (8, None, "assistant", "B."), (9, 5, None, "x" * 200_000 + "?"), (9, -5, "assistant", "é。"), (gone, 0, "user", "Hi.")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in "seg pos n k conv p q cost audit path initial blank".split()})
    found = got(repair.repair_digest(docs))
    assert found == expected(rows, walked)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_digest(docs.limit(0)).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    turns = repair.repair(spark.createDataFrame(random_rows(4, 40, 9), SCHEMA))[1].collect()
    by = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r["seg"], r["at"])):
        by[r["conv_id"]].append(r["role"][:1])
    assert by and all(GRAMMAR.match("".join(x)) for x in by.values())
