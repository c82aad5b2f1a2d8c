"""The filter audit against a walk of every document through every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from annalist.llm import audit
from tests.llm.test_operators import DOCS

LABELS = "doc_id long, quality int, toxic int"


def walked(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    docs = []
    for d, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [x for x, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
            d is not None and any(e is not None and e < d and (t or "") == text for e, t, *_ in rows)), strict=True) if bad]
        docs.append((source or "", fails, d in good and d is not None, d in toxic and d is not None))
    out = {}
    for part in {d[0] for d in docs}:
        removed_by = defaultdict(int)
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                here = [d for d in own if x in d[1] and not before & set(d[1])]
                removed_by[x] += len(here)
                kept = sum(not (before | {x}) & set(d[1]) for d in own)
                out[part, order, step] = [kept, len(here), sum(x in d[1] and bool(before & set(d[1])) for d in own), sum(d[1] == [x] for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def made(seed):
    r = random.Random(seed)
    pool = []
    for _ in range(14):
        n = r.choice([0, 1, 49, 50, 51, 80])
        words = [r.choice("abcdefgh") * r.randint(1, 9) for _ in range(n)] if r.random() < 0.4 else [f"w{r.randrange(10**6)}" for _ in range(n)]
        if r.random() < 0.3:
            words = [w.upper() for w in words]
        text = r.choice([" ", "\t", "\x1c ", "\n\n"]).join(words) + r.choice(["", "", "#", " 5 % |", "É", "  "])
        pool.append(text)
    rows = [(r.choice([None, *range(60)]), r.choice([*pool, None]), "en", r.choice(["s1", "s1", "s2", "", None]), 1) for _ in range(90)]
    rows += [(200, "X " * 40_000, "en", "long", 1), (201, "x y " * 40_000, "en", "long", 1), rows[0], rows[1]]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(50)]
    return rows, labels


def frames(spark, rows, labels):
    clash = "part mask hash size bucket good toxic n quality filter at".split()
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in clash}), spark.createDataFrame(labels, LABELS).withColumns({c: F.lit(7) for c in ("n", "good", "part", "text")})


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_walk(spark, seed):
    rows, labels = made(seed)
    out = audit.filter_audit(*frames(spark, rows, labels)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in out} == walked(rows, labels)
    assert len(out) == 600 * len({r["part"] for r in out})


def test_sql_gives_the_same(spark):
    rows, labels = made(3)
    docs, known = frames(spark, rows, labels)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    con.register("labels", known.select("doc_id", "quality", "toxic").toArrow())
    want = con.execute(f"select part, filter_order, step, {', '.join(audit.COUNTS)} from ({audit.ORACLE})").fetchall()
    assert sorted(want) == sorted(map(tuple, audit.filter_audit(docs, known).collect()))


def test_empty_tables(spark):
    rows, labels = made(4)
    docs, known = frames(spark, rows, labels)
    assert audit.filter_audit(docs.limit(0), known).count() == 0
    none = audit.filter_audit(docs, known.limit(0)).collect()
    assert none and not any(r["good_lost"] or r["toxic_lost"] for r in none)
