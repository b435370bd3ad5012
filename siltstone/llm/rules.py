"""Quality rules (2): rule statistics and an isolation forest over them.

Random splits isolate an odd document in few steps; the mean path length over
the trees gives its anomaly score, and labelled rows set the score from which
a document is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, chunks, cut, grams, hashes, mark, mix, owners, prepare, runs, spark_ints, text_bytes

#: Each tree is grown on LEAVES rows of the whole table, drawn by a hash that is salted with the tree's number: isolation is by few rows a tree, so this is the method's own. The threshold is set by all labelled rows.
TREES, LEAVES = 100, 256
#: Of the good labelled rows, the share that the threshold may reject.
FALSE_ALARMS = 0.01

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _by(owner: np.ndarray, n: int, values=None) -> np.ndarray:
    return np.bincount(owner, values, n).astype(np.int64)


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """For each place, whether an equal key stands at an earlier place."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def statistics(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The five statistics of each text of a chunk; see STATS."""
    n = len(offs) - 1
    starts, ends, first = runs(data, offs, SPACES)
    owner = owners(first)
    char = ((data & 0xC0) != 0x80) & ~SPACES[data]
    per_byte = np.concatenate([[0], np.cumsum(char)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    # lines: cut at \n and at text ends; a line counts if a word starts in it
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offs) if len(data) else offs
    ls, le = cuts[:-1], cuts[1:]
    own = np.searchsorted(offs, ls, "right") - 1
    if len(data):
        le = le - (data[np.maximum(le - 1, 0)] == 10)
    keep = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, own = ls[keep], le[keep], own[keep]
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    dup = _seen_before(hashes(data, ls, le) ^ salt[own]) if len(ls) else np.empty(0, bool)
    repeats = np.zeros(n, np.int64)
    g = grams(hashes(data, starts, ends), 3)
    if len(g):
        at = np.flatnonzero(owner[: len(g)] == owner[2:])
        keys = g[at] ^ salt[owner[at]]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = mark(len(starts), at[twice], at[twice] + 3)
        repeats = _by(owner[hit], n)
    return [np.diff(first), np.diff(per_byte[offs]), np.diff(symbols[offs]), _by(own[dup], n), repeats]


def add_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS, a row for each row of docs. Null text has no word: all zero. Needs doc_id and text."""

    def task(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            parts = [statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True))], ["doc_id", *(c.split()[0] for c in STATS.split(", "))])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id long, {STATS}")


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> np.ndarray:
    w = np.maximum(1, np.asarray(n_words, float))
    return np.column_stack([np.log1p(w), np.asarray(word_chars) / w, np.log1p(1000 * np.asarray(n_symbols) / w), np.log1p(1000 * np.asarray(n_dup_lines) / w), np.asarray(n_repeat_words) / w])


def _usual(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees side by side: feature (-1 at a leaf), split, left child (right is next to it), and path length at leaves."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1); 0.5 is usual."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(64):
                f = self.feature[t, node]
                go = f >= 0
                if not go.any():
                    break
                node = np.where(go, self.left[t, node] + (x[rows, np.maximum(f, 0)] >= self.split[t, node]), node)
            total += self.length[t, node]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.usual)


def grow(x: np.ndarray | list, trees: int = TREES, leaves: int = LEAVES, seed: int = 17) -> Forest:
    """A forest on rows of x, or on a list of each tree's rows."""
    rng = np.random.default_rng(seed)
    own = isinstance(x, list)
    trees, leaves = (len(x), max(map(len, x))) if own else (trees, min(leaves, len(x)))
    deepest = max(1, int(np.ceil(np.log2(max(2, leaves)))))
    size = 2 ** (deepest + 1) + 1
    f, s = np.full((trees, size), -1), np.zeros((trees, size))
    left, length = np.zeros((trees, size), int), np.zeros((trees, size))
    for t in range(trees):
        todo, free = [(0, x[t] if own else x[rng.choice(len(x), leaves, replace=False)], 0)], 1
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(open_):
                length[t, node] = depth + _usual(len(part))
                continue
            k = rng.choice(open_)
            cutoff = rng.uniform(low[k], high[k])
            cutoff = cutoff if cutoff > low[k] else high[k]
            f[t, node], s[t, node], left[t, node] = k, cutoff, free
            todo += [(free, part[part[:, k] < cutoff], depth + 1), (free + 1, part[part[:, k] >= cutoff], depth + 1)]
            free += 2
    return Forest(f, s, left, length, float(max(1e-9, _usual(leaves))))


def calibrate(score: np.ndarray, good: np.ndarray, most: float = FALSE_ALARMS, none: float = 2.0) -> float:
    """The score from which to reject: the best balance of caught bad rows against lost good ones, losing `most` of the good at most; `none`, above every score, without rows of both kinds or such a balance."""
    if not good.any() or good.all():
        return none
    order = np.argsort(-score, kind="stable")
    s, g = score[order], good[order]
    lost, caught = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    last = np.append(s[1:] < s[:-1], True)
    ok = last & (lost <= most) & (caught > lost)
    if not ok.any():
        return none
    return float(s[np.flatnonzero(ok)[np.argmax((caught - lost)[ok])]])


def threshold(scored: DataFrame, most: float = FALSE_ALARMS, none: float = 2.0) -> float:
    """calibrate() of all rows (score double, good boolean) of a table of any size: ranges of scores are summed up by themselves, and only their totals meet on the driver."""
    good = F.col("good").cast("long")
    counts = scored.groupBy("score").agg(F.sum(good).alias("g"), F.sum(1 - good).alias("b"))
    dealt = cut(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))
    before, g, b = [], 0, 0
    for r in sorted(dealt.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect()):
        before.append((r.part, g, b))
        g, b = g + r.g, b + r.b
    if not g or not b:
        return none
    above = Window.partitionBy("part").orderBy(F.desc("score"))
    rows = dealt.join(F.broadcast(scored.sparkSession.createDataFrame(before, "part int, g0 long, b0 long")), "part")
    lost, caught = (F.col("g0") + F.sum("g").over(above)) / F.lit(float(g)), (F.col("b0") + F.sum("b").over(above)) / F.lit(float(b))
    best = rows.select("score", lost.alias("lost"), caught.alias("caught")).where((F.col("lost") <= most) & (F.col("caught") > F.col("lost")))
    first = best.orderBy(F.desc(F.col("caught") - F.col("lost")), F.desc("score")).first()
    return none if first is None else first.score


_NAMES = [c.split()[0] for c in STATS.split(", ")]


def draw(stats: DataFrame, rows: int, trees: int = TREES, leaves: int = LEAVES) -> list[np.ndarray]:
    """The features of each tree's rows: the `leaves` of least salted hash among all `rows` of stats (doc_id, STATS). A little more than trees * leaves rows come to the driver."""
    share = min(1.0, (leaves + 8 * leaves**0.5) / max(1, rows))

    def task(batches):
        for batch in batches:
            h = batch.column(5).to_numpy().view(np.uint64)
            for t in range(trees):
                salted = mix(h ^ mix(np.array([t + 1], np.uint64)))
                some = np.flatnonzero(salted <= np.uint64(int(share * (2**64 - 2048))))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t, np.int32)), spark_ints(salted[some]), *(batch.column(k).take(pa.array(some)) for k in range(5))], ["tree", "h", *_NAMES])

    # equal rows differ by doc_id alone, and those that repeat it are alike
    got = stats.select(*_NAMES, F.xxhash64("doc_id", *_NAMES)).mapInArrow(task, f"tree int, h long, {STATS}").toArrow()
    x = features(*(got.column(c).to_numpy() for c in _NAMES))
    tree, h = got.column("tree").to_numpy(), got.column("h").to_numpy().view(np.uint64)
    order = np.lexsort((*x.T, h, tree))
    first = np.searchsorted(tree[order], np.arange(trees + 1))
    drawn = [x[order[i : min(j, i + leaves)]] for i, j in zip(first[:-1], first[1:], strict=True)]
    return [d for d in drawn if len(d)]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly (double; null if base_failed) and kept, for each row of docs.

    labels: doc_id, quality (0 is bad, more is good; null rows are ignored).
    The forest grows on rows that pass the base rules. Rows with a null
    doc_id are judged like others. Repeated rows and ties are judged alike.
    Null and empty texts have no word and fail the base rules; very long texts
    count whole. Without rows or labels of both kinds no row fails by its
    anomaly; an empty table gives no rows. Other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = cut(add_statistics(docs).withColumn("base_failed", failed))
    passed = stats.where(~F.col("base_failed"))
    count = passed.count()
    graded = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"))
    if count < 2:
        return stats.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    forest = grow(draw(passed, count))
    trees = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(trees.value.score(features(*(batch.column(c).to_numpy() for c in _NAMES)))), batch.column("good")], ["score", "good"])

    labelled = passed.join(graded, F.col("doc_id") == F.col("_id")).select(*_NAMES, (F.col("_q") > 0).alias("good"))
    limit = threshold(labelled.mapInArrow(score, "score double, good boolean"))
    model = docs.sparkSession.sparkContext.broadcast((forest, limit))

    def task(batches):
        forest, limit = model.value
        for batch in batches:
            bad = batch.column("base_failed").to_numpy(zero_copy_only=False)
            score = forest.score(features(*(batch.column(c).to_numpy() for c in _NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=bad), pa.array(~bad & (score < limit))], [*batch.schema.names, "anomaly", "kept"])

    return stats.mapInArrow(task, f"doc_id long, {STATS}, base_failed boolean, anomaly double, kept boolean")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge() over documents."""
    return judge(docs, labels)
