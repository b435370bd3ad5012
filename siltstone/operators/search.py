"""Exact cosine search: score, keep the k best, then look up texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import native

#: Queries of a block and numbers in the vectors of a part that search_many compares as a tile; queries and vectors at once, and what a matrix product may be off.
QUERIES, PART, AT_ONCE, NEAR = 8192, 1 << 22, 1024, 1e-9


def _check(query: list[float], k: int) -> list[float]:
    if k < 0:
        raise ValueError("top_k must not be negative")
    return [float(x) for x in query]


def scores(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """vectors with score. The query's norm is folded into literals; vectors whose norm is zero go, and all go if the query's is zero."""
    q = _check(query, 0)
    size = float(np.linalg.norm(q))
    if size == 0:
        return vectors.withColumn("score", F.lit(0.0)).where(F.lit(False))
    unit = F.lit([x / size for x in q])
    n = native.norm(vector)
    return vectors.where(n > 0).withColumn("score", native.dot(vector, unit) / n)


def topk(vectors: DataFrame, query: list[float], k: int = 5, vector: str = "embedding", order: str = "ingest_seq") -> DataFrame:
    """The k best rows of scores(); ties in `order`. Few if there are few. Vectors of another dimension raise."""
    _check(query, k)
    size = F.size(vector)
    ok = vectors.where(F.when(size == len(query), True).otherwise(F.raise_error(F.concat(F.lit(f"a query of dimension {len(query)} meets a vector of dimension "), size.cast("string"))).cast("boolean")))
    return scores(ok, query, vector).orderBy(F.desc("score"), F.asc(order)).limit(k)


def topk_packed(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """topk over the store's half-precision vectors (embedding binary, dimension, norm, ingest_seq): one matrix product for each Arrow batch."""
    q = np.asarray(_check(query, k), np.float64)
    size = float(np.linalg.norm(q))
    if size == 0:
        return vectors.withColumn("score", F.lit(0.0)).where(F.lit(False))
    unit = q / size

    @F.pandas_udf("double")
    def product(v: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(v), "<f2").astype(np.float64).reshape(len(v), -1) @ unit if len(v) else [])

    same = F.when(F.col("dimension") == len(q), True).otherwise(F.raise_error(F.concat(F.lit(f"a query of dimension {len(q)} meets a vector of dimension "), F.col("dimension").cast("string"))).cast("boolean"))
    rows = vectors.where(F.col("norm") > 0).where(same).withColumn("score", product("embedding") / F.col("norm"))
    return rows.orderBy(F.desc("score"), F.asc("ingest_seq")).limit(k)


def lookup(hits: DataFrame, chunks: DataFrame, hit_key: str = "chunk_id", key: str = "id") -> DataFrame:
    """Texts of the k hits, after the limit: a hit without a chunk is lost and not replaced. hits has k rows, so it is the broadcast side."""
    return chunks.join(F.broadcast(hits), chunks[key] == hits[hit_key])


def _tile(some: pa.Table, ask: pa.Table, k: int, vector: str, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ask, row of some, score) of the k best of a tile for each of its queries.

    A matrix product tells which rows can be among them; their scores are summed
    anew in the order of the dimensions, so that equal vectors tie wherever they lie.
    """
    v, q = (t.column(c).combine_chunks().cast(pa.list_(pa.float64())) for t, c in ((some, vector), (ask, "_query")))
    sizes = {*pc.unique(pc.list_value_length(v)).to_pylist(), *pc.unique(pc.list_value_length(q)).to_pylist()}
    if len(sizes) > 1:
        raise ValueError(f"queries and vectors are of several dimensions: {sorted(sizes)}")
    v, q = (np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) for x in (v, q))
    size, place = some.column("_norm").to_numpy(), np.empty(len(v), np.int64)
    place[pc.sort_indices(some.select([order]), [(order, "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(v))
    parts = [_some(v, q[j : j + AT_ONCE], size, place, k, j) for j in range(0, len(q), AT_ONCE)]
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _some(v: np.ndarray, q: np.ndarray, size: np.ndarray, place: np.ndarray, k: int, start: int):
    """_tile for some of its queries, from `start` on. The k best so far say what the next vectors must reach."""
    a = b = np.empty(0, np.int64)
    score, least = np.empty(0), np.full(len(q), -np.inf)
    for i in range(0, len(v), AT_ONCE):
        near = q @ v[i : i + AT_ONCE].T
        near /= size[i : i + AT_ONCE]
        np.copyto(near, np.inf, where=np.isnan(near))
        if k < near.shape[1] and i == 0:
            least = np.partition(near, -k, axis=1)[:, -k]
        x, y = np.nonzero(near >= least[:, None] - NEAR)
        if not len(x):
            continue
        y += i
        s = np.zeros(len(x))
        for d in range(q.shape[1]):
            s += v[y, d] * q[x, d]
        s /= size[y]
        a, b, score = _first(*map(np.concatenate, ((a, x), (b, y), (score, s))), place, k)
        held = np.bincount(a, minlength=len(q))
        last = np.nan_to_num(score[np.cumsum(held) - 1], nan=np.inf) if len(a) else score
        least = np.where(held == k, last, -np.inf)
    return a + start, b, score


def _first(a: np.ndarray, b: np.ndarray, score: np.ndarray, place: np.ndarray, k: int):
    """Of each a the k rows b of the greatest score, then the least place; NaN is greatest, as it is to Spark."""
    at = np.lexsort((place[b], -np.nan_to_num(score, nan=np.inf), a))
    a, b, score = a[at], b[at], score[at]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], score[keep]


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", order: str = "ingest_seq", with_vector: bool = True) -> DataFrame:
    """The k best vectors for each query (query_id, query): query_id, rank and the vectors' columns, `vector` itself only if asked for.

    Any number of queries. Blocks of about QUERIES of them meet parts of vectors
    of about PART numbers in tiles, of which each keeps k rows a query; nothing
    but numbers of rows reaches the driver. Unequal dimensions raise.
    """
    if k < 0:
        raise ValueError("top_k must not be negative")
    q = queries.select("query_id", native.l2_normalize("query").alias("_query"), native.norm("query").alias("_n")).where("_n > 0").drop("_n")
    rows = vectors.withColumn("_norm", native.norm(vector)).where("_norm > 0")
    n, numbers = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size(vector).cast("long")), F.lit(0))).first()
    n_blocks, cores = max(1, -(-q.count() // QUERIES)), vectors.sparkSession.sparkContext.defaultParallelism
    # a tile for each core, if that leaves some vectors to each
    n_parts = max(1, -(-numbers // PART), min(-(-cores // n_blocks), n // AT_ONCE))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("_part", deal(order, n_parts)).withColumn("_block", upto(n_blocks))
    right = q.withColumn("_block", deal("query_id", n_blocks)).withColumn("_part", upto(n_parts))
    names = [c for c in vectors.columns if c not in ("query_id", "score", "rank") and (with_vector or c != vector)]
    schema = T.StructType([*(vectors.schema[c] for c in names), q.schema["query_id"], T.StructField("score", T.DoubleType())])

    def compare(some: pa.Table, ask: pa.Table) -> pa.Table:
        a = b = score = np.empty(0, np.int64)
        if k and some.num_rows and ask.num_rows:
            a, b, score = _tile(some, ask, k, vector, order)
        own = some.select(names).take(pa.array(b))
        return own.append_column("query_id", ask.column("query_id").take(pa.array(a))).append_column("score", pa.array(score, pa.float64()))

    tile = ["_part", "_block"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(order))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
