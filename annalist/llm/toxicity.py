"""Severity grades of texts: cumulative-link ordinal regression on sparse word features.

All thresholds share one weight vector: P(grade >= k) = sigmoid(w x - t_k) with t_1 < t_2 < ...  The expected severity of a
text is the sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import dropped, gathered, lean, prepare, runs_of, slices, stored, text_bytes, texts_of
from annalist.llm.words import SIGNS, word_bounds, word_hashes

#: Labelled rows that a fit reads at most, half of them of grade 0: those with the least hash of their id.
SAMPLE = 8000
#: Texts in which a feature must occur in the sample.
LEAST_TEXTS = 5
#: Chi-square of a feature against the label from which it is used.
LEAST_CHI = 15.0
#: Expected severity from which a text is rejected.
REJECT = 0.5
#: Bytes of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 7)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches a..b of rows: feature hashes and the row (from a) of each, repeats included.

    Features are words (lower case; ASCII signs between them) and the beginnings of longer ones.
    """
    data, offsets = text_bytes(pc.utf8_lower(column))
    for a, b in slices(offsets):
        own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, counts = word_bounds(own, off, SIGNS)
        row = np.repeat(np.arange(b - a), counts)
        hashes, rows = [word_hashes(own, starts, ends)], [row]
        for n in BEGINNINGS:
            long = np.flatnonzero(ends - starts > n)
            hashes.append(word_hashes(own, starts[long], starts[long] + n) ^ np.uint64(n))
            rows.append(row[long])
        yield a, b, np.concatenate(hashes), np.concatenate(rows)


@dataclass
class Ordinal:
    """A fitted model: ascending feature hashes with weights, and ascending thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True

    def scores(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sum of the weights of each row's distinct features."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(n)
        some = self.filter[hashes >> np.uint64(44)]
        hashes, rows = hashes[some], rows[some]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        pairs = np.unique(rows[hit] * len(self.keys) + at[hit])
        return np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], n)

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, size: int, grades: np.ndarray, l2: float = 3e-5, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for binary features at (row, column); rows ascending.  Adam on the mean log-loss."""
    n, levels = len(grades), max(int(grades.max(initial=0)), 1)
    share = [min(max((grades >= k).mean(), 1e-3), 1 - 1e-3) for k in range(1, levels + 1)]
    first = np.log(1 / np.array(share) - 1)
    p = np.concatenate([np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        t = np.concatenate([p[size : size + 1], p[size] + np.cumsum(np.exp(p[size + 1 :]))])
        s = np.bincount(rows, p[columns], n)
        c = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -40, 40)))  # P(grade >= k)
        c = np.hstack([np.ones((n, 1)), c, np.zeros((n, 1))])
        low, high = c[np.arange(n), grades], c[np.arange(n), grades + 1]
        own = np.maximum(low - high, 1e-9)
        d_low, d_high = low * (1 - low) / own, high * (1 - high) / own  # d log P / d score has d_low - d_high
        g_score = -(d_low - d_high) / n
        g_t = np.array([(np.where(grades == k, d_low, 0) - np.where(grades == k - 1, d_high, 0)).sum() / n for k in range(1, levels + 1)])
        g = np.concatenate([np.bincount(columns, g_score[rows], size) + l2 * p[:size], [g_t.sum()], [g_t[k:].sum() * np.exp(p[size + k]) for k in range(1, levels)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:size], np.concatenate([p[size : size + 1], p[size] + np.cumsum(np.exp(p[size + 1 :]))])


def crossed(rows: np.ndarray, columns: np.ndarray, size: int, grades: np.ndarray) -> np.ndarray:
    """The score of every row by a model of the other half of the rows, above that model's threshold."""
    out, half = np.zeros(len(grades)), np.arange(len(grades)) % 2
    for k in (0, 1):
        own = half == k
        if grades[own].max(initial=0) > 0:
            number = np.cumsum(own) - 1
            use = own[rows]
            weights, thresholds = fit_ordinal(number[rows[use]], columns[use], size, grades[own])
            out[~own] = np.bincount(rows, weights[columns], len(grades))[~own] - thresholds[0]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, spread: bool = True) -> Ordinal:
    """Fit on at most ``sample`` labelled texts: ``labels`` (doc_id, ``label`` = 0, 1, ...; null: not labelled).

    If the labels only say yes or no and ``spread`` is set, texts with the label are graded 1 or 2, so that the model learns
    mild and severe cases: by whether a yes-or-no model of the other half of the sample gives them more than the median.
    Without rows of a grade above 0, or features that go with it, every score is 0 and nothing is rejected.  Of several labels
    of a doc_id the highest counts, of several texts the one whose features come first; a null doc_id has no label.
    """
    spark = docs.sparkSession
    prepare(spark)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("long")).alias("grade"))
    totals = {r["bad"]: r["n"] for r in chosen.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    first = [chosen.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for c in ("grade > 0", "grade = 0")]
    chosen = first[0].unionByName(first[1])  # the sample's bound is the bound of what is broadcast

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, rows in features(batch.column(1)):
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                first, _ = runs_of(rows, hashes)
                at = np.searchsorted(rows[first], np.arange(b - a + 1))
                blobs = [hashes[first[x:y]].tobytes() for x, y in zip(at, at[1:])]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(blobs, pa.binary())], names=["doc_id", "grade", "features"])

    bad, good = totals.get(True, 0), totals.get(False, 0)
    bad_sample, sampled = min(bad, sample // 2), min(bad, sample // 2) + min(good, sample // 2)
    nothing = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0]))
    if not bad_sample:
        return nothing
    texts = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    table = stored(texts.mapInArrow(lean(found), "doc_id long, grade long, features binary").groupBy("doc_id", "grade").agg(F.min("features").alias("features")), "features")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            keys, at, n = np.unique(every, return_inverse=True, return_counts=True)
            yes = np.bincount(at, np.repeat(batch.column(0).to_numpy() > 0, list(map(len, sets))), len(keys))
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n), pa.array(yes.astype(np.int64))], names=["key", "n", "yes"])

    # features whose frequency depends on the label, by a chi-square test; the others would only be learnt by heart
    share = bad_sample / sampled
    expected = F.col("n") * share
    sums = table.select("grade", "features").mapInArrow(lean(counted), "key long, n long, yes long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes"))
    least = min(LEAST_TEXTS, max(2, sampled // 20))
    telling = sums.where((F.col("n") >= least) & ((F.col("yes") - expected) ** 2 / expected / max(1 - share, 1e-9) >= LEAST_CHI))
    keys = np.sort(telling.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    if not len(keys):
        return nothing

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for x in batch.column(2).to_pylist():
                x = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                own.append(at[keys[at] == x].astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["doc_id", "grade", "features"])

    small = table.mapInArrow(lean(kept), "doc_id long, grade long, features binary").toPandas().sort_values("doc_id")
    dropped(table)
    if not len(small):
        return nothing
    sets = [np.frombuffer(x, np.int32) for x in small["features"]]
    grades = small["grade"].to_numpy(np.int64)
    toxic = grades > 0
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    columns = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
    if grades.max() == 1 and spread and not toxic.all():
        held_out = crossed(rows, columns, len(keys), grades)
        grades = grades + (toxic & (held_out > np.median(held_out[toxic])))
    weights, thresholds = fit_ordinal(rows, columns, len(keys), grades)
    # the sample has more of the graded texts than the corpus: the odds are set right
    odds = lambda x, y: np.log(max(x, 1) / max(y, 1))
    thresholds = thresholds + odds(toxic.sum(), (~toxic).sum()) - odds(bad, good)
    return Ordinal(keys, weights, thresholds)


def score(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """doc_id, severity_grade (the most probable), expected_severity, rejected (expected_severity >= reject) for every row.

    A null or empty text has no features.  Repeated rows give equal results.
    """
    prepare(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, rows in features(batch.column(1)):
                above = model.at_least(model.scores(hashes, rows, b - a))
                cells = np.hstack([np.ones((b - a, 1)), above]) - np.hstack([above, np.zeros((b - a, 1))])
                severity = above.sum(1)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(cells.argmax(1)), pa.array(severity), pa.array(severity >= reject)], names=["doc_id", "severity_grade", "expected_severity", "rejected"])

    return texts_of(docs).mapInArrow(lean(scored), "doc_id long, severity_grade long, expected_severity double, rejected boolean")


def drop_toxic(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """``docs`` without rejected texts, all columns as they were; rows with a null or empty text stay."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, hashes, rows in features(batch.column(at).fill_null("")):
                keep[a:b] = model.at_least(model.scores(hashes, rows, b - a)).sum(1) < reject
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(kept), docs.schema)
