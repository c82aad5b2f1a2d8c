"""The pipeline's stages, each on what the one before kept, against brute force on a small corpus."""

import random
import re

import pytest

import corpus_pipeline
from annalist.llm.common import stored
from tests.llm.test_operators import AWKWARD, DOCS, brute_components, encode, words_text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    item = words_text(r, 40)
    rows = [(d, "\n".join(words_text(r, 30) for _ in range(3)), "en", f"s{d % 13}", 1) for d in range(300)]
    rows += [(1000 + d, rows[d][1], "en", "s1", 1) for d in range(20)]
    rows += [(1100 + d, rows[d][1].replace(rows[d][1].split()[5], "zzz", 1), "en", "s2", 1) for d in range(20, 30)]
    rows += [(1200 + d, f"{words_text(r, 40)} {item} {words_text(r, 30)}", "en", "s3", 1) for d in range(5)]
    rows += [(1300 + d, " ".join(w if k % 9 else "vilename" for k, w in enumerate(words_text(r, 60).split())), "en", "s4", 1) for d in range(60)]
    rows += [(1400 + d, f"{words_text(r, 50)}\nshared boilerplate line of every site\n{words_text(r, 20)}", "en", f"s{d}", 1) for d in range(13)]
    rows += [(2000 + k, *a[1:]) for k, a in enumerate(AWKWARD)]
    labels = [(d, 1, 0) for d in range(0, 300, 2)] + [(1300 + d, 0, 1) for d in range(0, 60, 2)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, cut, once, clean = kept
    assert not any(1300 <= d < 1360 for d in toxic) and all(d in toxic for d in range(300))
    assert sum("shared boilerplate" in (t or "") for t in cut.values()) == 1 and all(d in cut for d in range(300))
    classes = {c for _, c in brute_components(list(cut.items()), 5, 80, 100).values()}
    assert set(once) == classes and all(d in once for d in range(300))
    assert not any(1200 <= d < 1205 for d in clean) and all(d in clean for d in range(300))
    lengths = {}
    for r in docs.collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(encode(t)) + 1 for d, t in clean.items()}


def test_run_equals_stages_on_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_run(toxic_kept, item):
    """(doc_id, tokens) of what run() packs, from the rows that the severity model keeps, by plain Python."""
    rows = {d: (t, s) for d, t, s in toxic_kept}
    sites, first = {}, {}
    for d, (t, s) in sorted(rows.items()):
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" ")
            if t is not None and line:
                first.setdefault(line, (d, k))
                if s is not None:
                    sites.setdefault(line, set()).add(s)
    bad = {x for x, own in sites.items() if len(own) >= 10}
    cut = {}
    for d, (t, _) in rows.items():
        lines = (t or "").split("\n")
        keep = [x for k, x in enumerate(lines) if x.strip(" ") not in bad or first[x.strip(" ")] == (d, k)]
        if len(keep) == len(lines) or "\n".join(keep).strip(" "):
            cut[d] = t if len(keep) == len(lines) else "\n".join(keep)
    components = brute_components(list(cut.items()), 5, 80, 100)
    once = {d: t for d, t in cut.items() if components[d][1] == d}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    own = words(item)

    def overlaps(w):
        for diagonal in range(-len(own) + 13, len(w) - 12):
            equal = [w[k + diagonal] == own[k] for k in range(max(0, -diagonal), min(len(own), len(w) - diagonal))]
            if any(4 * sum(equal[a:b]) >= 3 * (b - a) for a in range(len(equal)) for b in range(a + 13, len(equal) + 1)) if sum(equal) >= 10 else False:
                return True
        return False

    return {d: len(encode(t)) + 1 for d, t in once.items() if not overlaps(words(t)[:2000])}


def test_run_against_brute_force(spark, folder, tmp_path):
    """The whole run on rows with one text each; what the model rejects is taken from its stage, which held-out labels judge."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"]).where("length(coalesce(text, '')) < 20000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()]
    item = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first()["text"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths, places = {}, {}
    for r in out:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert lengths == brute_run(kept, item)
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
