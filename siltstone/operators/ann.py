"""Approximate nearest neighbours by cosine: inverted lists with residual codes.

Unit vectors are dealt to lists by k-means, whose rounds run over all vectors;
only its start comes from a bounded sample. The index is a Parquet folder with
one subfolder a list, and holds of each vector what is left of it beyond its
list's centre, a signed byte a dimension. A query looks into the lists whose
centres are nearest to it, ranks what lies there by the codes, and scores the
best of these by the vectors themselves. How many lists are looked into is
calibrated when the index is built: exact neighbours of sampled vectors say how
far down the order of lists they lie.

Any number of queries is one plan. Parts of all lists meet blocks of queries in
tiles of bounded size, so neither a crowded list nor a popular one is one task;
a tile goes through its lists and keeps the best of each query, not of each
query and list.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import native
from siltstone.operators.shared import cut

#: Lists at most; sampled vectors that k-means starts from, and that calibrate the probes.
LISTS, SAMPLE, TRIALS = 4096, 32_768, 256
#: Vectors of a file of the index; bytes of codes and queries of a tile; vectors, and queries, that are compared at once.
PART, CODES, QUERIES, AT_ONCE, ASKED = 16_384, 1 << 24, 8192, 4096, 1024

_ROWS = "id long, code binary, list int"


def unit(df: DataFrame, key: str, vector: str, dimension: int | None = None) -> DataFrame:
    """id, v: vectors of length 1 as floats. Null and zero vectors and rows without id go; a vector of another dimension raises."""
    rows = df.where(F.col(key).isNotNull() & (native.norm(vector) > 0)).select(F.col(key).cast("long").alias("id"), native.l2_normalize(vector).cast("array<float>").alias("v"))
    if dimension:
        size = F.size("v")
        rows = rows.where(F.when(F.col("v").isNull() | (size == dimension), True).otherwise(F.raise_error(F.concat(F.lit(f"an index of dimension {dimension} meets a vector of dimension "), size.cast("string"))).cast("boolean")))
    return rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """`most` rows at most, of the least hashes of their ids; about as many are sorted, however many there are."""
    h = F.xxhash64("id")
    if n > most:
        share = (most + 8 * most**0.5) / n
        rows = rows.where(h <= F.lit(int(min(1.0, share) * (2**64 - 2048)) - 2**63))
    return rows.orderBy(h, "id").limit(most)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, best first."""
    k = min(k, score.shape[1])
    top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.tile(np.arange(k), (len(score), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


def exact(rows: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """query (row number), id, score, v: the k nearest of all unit vectors to each of a bounded number of queries; each task keeps k a query."""
    sent = rows.sparkSession.sparkContext.broadcast(queries.astype(np.float32))

    def task(batches):
        q = sent.value
        score, ids, vs = np.empty((len(q), 0), np.float32), np.empty((len(q), 0), np.int64), np.empty((len(q), 0, q.shape[1]), np.float32)
        for batch in batches:
            v, own = _matrix(batch.column("v"), q.shape[1]), batch.column("id").to_numpy()
            for i in range(0, len(v), AT_ONCE):
                part = q @ v[i : i + AT_ONCE].T
                top = _best(part, k)
                s = np.hstack([score, np.take_along_axis(part, top, 1)])
                keep = _best(s, k)
                score = np.take_along_axis(s, keep, 1)
                ids = np.take_along_axis(np.hstack([ids, own[i + top]]), keep, 1)
                vs = np.take_along_axis(np.concatenate([vs, v[i + top]], axis=1), keep[:, :, None], 1)
        n = ids.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(ids.ravel()), pa.array(score.ravel()), pa.array(list(vs.reshape(-1, q.shape[1])), pa.list_(pa.float32()))], ["query", "id", "score", "v"])

    found = rows.mapInArrow(task, "query long, id long, score float, v array<float>")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(v[i : i + AT_ONCE] @ centres.T).argmax(1) for i in range(0, len(v), AT_ONCE)] or [np.empty(0, np.int64)])


def _mean(total: np.ndarray, count: np.ndarray, old: np.ndarray) -> np.ndarray:
    """New centres of length 1; a list without vectors keeps its own."""
    size = np.linalg.norm(total, axis=1)
    good = (count > 0) & (size > 0)
    return np.where(good[:, None], total / np.where(good, size, 1)[:, None], old).astype(np.float32)


def _round(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres after one round over all vectors: each task sums its own by list, then the tasks' sums of a list meet."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    width = centres.shape[1]

    def partial(batches):
        centres = sent.value
        total, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            own = _nearest(v, centres)
            np.add.at(total, own, v)
            count += np.bincount(own, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["list", "n", "total"])

    def merge(key, group):
        total = group.column("total").combine_chunks().flatten().to_numpy().reshape(-1, width).sum(0)
        return pa.table({"list": [key[0].as_py()], "n": [sum(group.column("n").to_pylist())], "total": [total.tolist()]})

    sums = rows.select("v").mapInArrow(partial, "list long, n long, total array<double>").groupBy("list").applyInArrow(merge, "list long, n long, total array<double>").toArrow()
    total, count = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
    at = sums.column("list").to_numpy()
    total[at], count[at] = np.array(sums.column("total").to_pylist()).reshape(-1, width), sums.column("n").to_numpy()
    sent.destroy()
    return _mean(total, count, centres)


@dataclass
class VectorIndex:
    """An index at `path`: centres of lists, the step of each dimension's code, and lists to look into for the recall it was built for."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    step: np.ndarray
    probes: int

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")

    def save(self) -> VectorIndex:
        meta = json.dumps({"step": self.step.tolist(), "probes": self.probes})
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "list int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        return self


def load(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    centres = [r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()]
    return VectorIndex(spark, path, np.array(centres, np.float32), np.array(meta["step"], np.float32), meta["probes"])


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, rounds: int = 3, recall: float = 0.97, k: int = 10) -> VectorIndex:
    """Build an index of all vectors at `path` (a new folder).

    lists: the square root of the number of vectors unless given, LISTS at
    most. K-means starts from SAMPLE vectors and has `rounds` rounds over all.
    recall: what share of the k nearest the lists looked into should hold, as
    TRIALS sampled vectors and their exact neighbours show. Ids are whole
    numbers; rows that repeat an id are vectors of their own. Null and zero
    vectors are not indexed; vectors of unequal dimensions raise. Needs a
    vector at least.
    """
    spark = vectors.sparkSession
    rows = unit(vectors, key, vector)
    n, dimension = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("an index needs a vector at least")
    rows = cut(unit(vectors, key, vector, dimension))  # gone through some ten times
    some = _matrix(_sample(rows, n, SAMPLE).select("v").toArrow().column("v").combine_chunks(), dimension)
    count = min(lists or LISTS, max(1, round(n**0.5)) if lists is None else lists, LISTS, len(some))
    centres = some[np.linspace(0, len(some) - 1, count).astype(int)]
    for _ in range(4):  # a start on the sample; the rounds that count are those over all vectors
        own = _nearest(some, centres)
        total = np.zeros(centres.shape)
        np.add.at(total, own, some)
        centres = _mean(total, np.bincount(own, minlength=count), centres)
    for _ in range(rounds):
        centres = _round(rows, centres)
    step = np.maximum(np.abs(some - centres[_nearest(some, centres)]).max(0) * 1.25, 1e-6) / 127
    sent = spark.sparkContext.broadcast((centres, step.astype(np.float32)))

    def encode(batches):
        centres, step = sent.value
        for batch in batches:
            v = _matrix(batch.column("v"), dimension)
            own = _nearest(v, centres)
            code = np.clip(np.rint((v - centres[own]) / step), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(own.astype(np.int32))], ["id", "code", "list"])

    coded = rows.mapInArrow(encode, _ROWS)
    # a crowded list is written by some tasks, of about PART rows each
    spread = max(1, -(-n // (PART * 8)))
    tasks = max(spread, spark.sparkContext.defaultParallelism)
    coded.repartition(tasks, "list", F.pmod(F.xxhash64("id"), F.lit(spread))).write.partitionBy("list").parquet(f"{path}/rows")
    # how far down the order of lists the exact neighbours of sampled vectors lie
    trial = some[: min(TRIALS, len(some))]
    near = exact(rows, trial, k).select("query", "v").toArrow()
    own = _nearest(_matrix(near.column("v").combine_chunks(), dimension), centres)
    order = np.argsort(np.argsort(-(trial @ centres.T), axis=1, kind="stable"), axis=1)
    depth = order[near.column("query").to_numpy(), own] + 1
    probes = int(np.quantile(depth, recall, method="higher"))
    return VectorIndex(spark, path, centres, step.astype(np.float32), probes).save()


def _ranked(q: np.ndarray, own: np.ndarray, code: np.ndarray, centres: np.ndarray, step: np.ndarray, probes: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of code, nearness) of the `depth` nearest codes to each query in the lists it looks into. own: the codes' lists, ascending."""
    looks = np.zeros((len(q), len(centres)), bool)
    np.put_along_axis(looks, _best(q @ centres.T, probes), True, 1)
    held, more, waiting = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))], [], 0
    least = np.full(len(q), -np.inf, np.float32)

    def best() -> None:
        """Of what is held and waits, the best of each query, and what others must reach from now on."""
        nonlocal held, more, waiting
        a, b, near = map(np.concatenate, zip(*held, *more, strict=True))
        at = np.lexsort((-near, a))
        a, b, near = a[at], b[at], near[at]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        full = rank == depth - 1
        least[a[full]] = near[full]
        keep = rank < depth
        held, more, waiting = [(a[keep], b[keep], near[keep])], [], 0

    for i in range(0, len(code), AT_ONCE):
        lists = own[i : i + AT_ONCE]
        some = np.flatnonzero(looks[:, np.unique(lists)].any(1))
        if not len(some):
            continue
        near = q[some] @ (centres[lists] + code[i : i + AT_ONCE] * step).T
        low = least[some]
        if (new := np.isneginf(low)).any() and depth < near.shape[1]:
            # nothing to reach yet: the slice's own best say what is worth keeping
            low[new] = np.partition(np.where(looks[np.ix_(some[new], lists)], near[new], -np.inf), -depth, axis=1)[:, -depth]
        x, y = np.nonzero(near >= low[:, None])
        seen = looks[some[x], lists[y]]
        x, y = x[seen], y[seen]
        more.append((some[x], i + y, near[x, y]))
        waiting += len(x)
        if waiting > len(q) * depth:
            best()
    best()
    return held[0]


def search(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, depth: int | None = None) -> DataFrame:
    """query_id, rank, id, score: about the k nearest vectors to each row of queries (query_id, query), best first, ties by id.

    vectors: the table that the index was built of; the best `depth` (4 * k)
    of a query by their codes are looked up in it and scored exactly. Null and
    zero queries find nothing; a query of another dimension raises. Only
    folders of lists that a query looks into are read.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    spark, (count, dimension) = index.spark, index.centres.shape
    probes, depth = min(count, probes or index.probes), depth or max(1, 4 * k)
    sent = spark.sparkContext.broadcast((index.centres, index.step))

    def probe(batches):
        centres, _ = sent.value
        for batch in batches:
            q = _matrix(batch.column("v"), dimension)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_best(q @ centres.T, probes)).astype(np.int32))], ["list"])

    asked = cut(unit(queries, "query_id", "query", dimension))
    rows = index.rows()
    # LISTS numbers at most
    lists = [r[0] for r in asked.mapInArrow(probe, "list int").distinct().collect()]
    if len(lists) < count:
        rows = rows.where(F.col("list").isin(lists))
    n, blocks, cores = rows.count(), max(1, -(-asked.count() // QUERIES)), spark.sparkContext.defaultParallelism
    # a tile for each core, if that leaves some vectors to each
    parts = max(1, -(-n * dimension // CODES), min(-(-cores // blocks), n // AT_ONCE))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    tile = ["part", "block"]
    left = rows.withColumn("part", deal(parts)).withColumn("block", upto(blocks))
    right = asked.withColumn("block", deal(blocks)).withColumn("part", upto(parts))

    def compare(some: pa.Table, ask: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        if some.num_rows and ask.num_rows:
            centres, step = sent.value
            some = some.sort_by("list")
            own, code = some.column("list").to_numpy(), np.frombuffer(b"".join(some.column("code").to_pylist()), np.int8).reshape(-1, dimension)
            q, ids, asks = _matrix(ask.column("v").combine_chunks(), dimension), some.column("id").to_numpy(), ask.column("id").to_numpy()
            for j in range(0, len(q), ASKED):
                a, b, near = _ranked(q[j : j + ASKED], own, code, centres, step, probes, depth)
                found.append((asks[j + a], ids[b], near))
        return pa.table(dict(zip(("query_id", "id", "near"), (pa.array(np.concatenate(x)) for x in zip(*found, strict=True)), strict=True)))

    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, "query_id long, id long, near float")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    few = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= depth).select("query_id", "id").distinct()
    exactly = few.join(unit(vectors, key, vector, dimension), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = exactly.select("query_id", "id", native.dot(F.col("v").cast("array<double>"), F.col("q").cast("array<double>")).alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
