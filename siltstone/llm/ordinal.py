"""Quality classifier (8): ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = logistic(threshold[k] - f(text)), with one weight vector
shared by all grades and ordered thresholds. f sums the weights of the hashed
features that a text holds: its words, their first four to six bytes (which
catches inflected forms of a stem), and coarse bins of simple statistics.
Fitted by mini-batch AdaGrad with an L1 step, which leaves rare features at
nought.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, chunks, hashes, least_hashed, mix, owners, prepare, runs, text_bytes
from .rules import calibrate, statistics

#: Hash bits; labelled rows that are used at most (those of the least xxhash64(doc_id)); of these, the share held back to set the cut.
BITS, LABELLED, HELD = 20, 12_000, 0.25
#: Share of best-grade rows that the cut may reject.
FALSE_ALARMS = 0.005
_STATS = 1024


def featurize(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct feature of each text, ordered by text."""
    n = len(offs) - 1
    low = LOWER[data]
    starts, ends, first = runs(low, offs, NOT_ALNUM)
    own = owners(first)
    found = [hashes(low, starts, ends)]
    for k in (4, 5, 6):
        long = ends - starts > k
        found.append(mix(hashes(low, starts[long], starts[long] + k) + np.uint64(k)))
        own = np.concatenate([own, owners(first)[long]])
    room = (1 << BITS) - _STATS
    bucket = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64) % room
    words, _, symbols, dups, repeats = statistics(data, offs)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    w, size = np.maximum(words, 1), np.maximum(np.diff(offs), 1)
    bins = [np.log2(w).astype(int), np.minimum(63, 64 * np.diff(upper[offs]) // size), np.minimum(63, 64 * repeats // w), np.minimum(63, 16 * symbols // w), np.minimum(63, 16 * dups // w)]
    stats = [room + 64 * i + b for i, b in enumerate(bins)]
    key = np.unique(np.concatenate([own << BITS | bucket, *(np.arange(n) << BITS | s for s in stats)]))
    return key >> BITS, key & ((1 << BITS) - 1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]
    cut: float

    def score(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(text, self.weights[bucket], n)

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k >= 1, a column each."""
        return _logistic(f[:, None] - self.thresholds[None, :])


def fit(first: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: list[int], epochs: int = 14, batch: int = 256, rate: float = 0.3, sparsity: float = 2e-4, seed: int = 5) -> Model:
    """Features of row i are bucket[first[i]:first[i+1]]; grade is an index into grades."""
    k = len(grades) - 1
    w, g2 = np.zeros(1 << BITS, np.float64), np.full(1 << BITS, 1e-2)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=k + 1))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    t2 = np.full(k, 1e-1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            size = first[rows + 1] - first[rows]
            at = np.repeat(first[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            b, own = bucket[at], np.repeat(np.arange(len(rows)), size)
            f = np.bincount(own, w[b], len(rows))
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            y = grade[rows]
            hi, lo = _logistic(edges[y + 1] - f), _logistic(edges[y] - f)
            p = np.maximum(hi - lo, 1e-9)
            df = -(1 - hi - lo)
            dt = np.bincount(y, hi * (1 - hi) / p, k + 1)[:k] - np.bincount(y, lo * (1 - lo) / p, k + 1)[1:]
            g = np.bincount(b, df[own], 1 << BITS) / len(rows)
            on = np.flatnonzero(g)
            g2[on] += g[on] ** 2
            step = rate / np.sqrt(g2[on])
            v = w[on] + step * g[on]
            w[on] = np.sign(v) * np.maximum(0, np.abs(v) - step * sparsity)
            t2 += (dt / len(rows)) ** 2
            theta = np.maximum.accumulate(theta + rate * dt / len(rows) / np.sqrt(t2) + 1e-9 * np.arange(k))
    return Model(w.astype(np.float32), theta, grades, -np.inf)


def learn(docs: DataFrame, ratings: DataFrame) -> Model | None:
    """Fit on ratings (doc_id, grade int); null grades and repeats of a doc_id (the least grade holds) aside. None without two grades."""
    prepare(docs.sparkSession)
    graded = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("grade").alias("_grade"))
    some = least_hashed(graded, "_id", LABELLED)  # at most LABELLED rows of 12 bytes: safe to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_grade")

    def task(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            feats: list = []
            for i, j in chunks(offs):
                text, bucket = featurize(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                feats += [x.astype(np.int32).tobytes() for x in np.split(bucket, np.searchsorted(text, np.arange(1, j - i)))]
            if feats:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.binary())], ["doc_id", "grade", "features"])

    got = rows.mapInArrow(task, "doc_id long, grade int, features binary").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    grade = got.column("grade").to_numpy()
    grades = sorted(set(grade.tolist()))
    if len(grades) < 2:
        return None
    grade = np.searchsorted(grades, grade)
    parts = [np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()]
    del got
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    bucket = np.concatenate(parts)
    held = np.random.default_rng(3).random(len(grade)) < HELD
    use, check = np.flatnonzero(~held), np.flatnonzero(held)
    if len(np.unique(grade[use])) < len(grades) or not len(check):
        use = check = np.arange(len(grade))
    model = fit(*_rows(first, bucket, use), grade[use], grades)
    f1, b1 = _rows(first, bucket, check)
    f = model.score(np.repeat(np.arange(len(check)), np.diff(f1)), b1, len(check))
    model.cut = -calibrate(-f, grade[check] == len(grades) - 1, FALSE_ALARMS, np.inf) if (grade[check] < len(grades) - 1).any() else -np.inf
    return model


def _rows(first, bucket, rows):
    size = np.diff(first)[rows]
    at = np.repeat(first[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.concatenate([[0], np.cumsum(size)]), bucket[at]


VERDICT = "struct<expected_grade:double,top_probability:double,tails:array<double>,kept:boolean>"


def grade(docs: DataFrame, model: Model | None, into: str = "verdict") -> DataFrame:
    """docs with a struct column `into`: expected grade, P(best grade), P(grade >= k) for each k above the lowest, and kept.

    Kept is false where f(text) is at most the calibrated cut. Null and empty
    texts have features of their statistics only and are graded like others.
    Without a model everything is kept and grades are null. Very long texts are
    graded whole; repeated rows and ties are graded alike; an empty table gives
    no rows. A column of docs that is called `into` is replaced (fresh() of
    .common gives a name that isn't); docs needs text.
    """
    docs = docs.drop(into)
    if model is None:
        return docs.withColumn(into, F.expr(f"cast(named_struct('expected_grade', null, 'top_probability', null, 'tails', null, 'kept', true) as {VERDICT})"))
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches):
        m = sent.value
        steps = np.diff(np.array(m.grades, float))
        for batch in batches:
            data, offs = text_bytes(batch.column(at))
            f = [np.empty(0)]
            for i, j in chunks(offs):
                f.append(m.score(*featurize(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), j - i))
            f = np.concatenate(f)
            tails = m.tails(f)
            cols = [pa.array(m.grades[0] + tails @ steps), pa.array(tails[:, -1]), pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * len(steps), pa.int32()), pa.array(tails.ravel())), pa.array(f > m.cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(cols, ["expected_grade", "top_probability", "tails", "kept"])], [*batch.schema.names, into])

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(VERDICT))]))


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of labels(doc_id, quality, toxic): 0 toxic, 1 poor, 2 good; rows that lack either label have none."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("toxic").isNotNull(), F.when(F.col("quality") > 0, 2).when(F.col("quality").isNotNull(), 1)).alias("grade"))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's expected grade, tail probabilities and verdict."""
    out = grade(docs.select("doc_id", "text"), learn(docs, ratings(labels)))
    return out.select("doc_id", "verdict.*")
