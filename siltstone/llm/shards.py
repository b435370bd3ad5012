"""Sharding (7): longest-processing-time scheduling of groups that must stay together.

Groups (equal values of a key) are sorted by size, largest first, and each goes
to the shard that has the least load, through a heap. The driver never sees the
groups: it sees how many there are of each total size and schedules a whole
class of equal groups in a few strokes, since groups of one size that go to
levelled shards go there in turn. A group finds its shard by its number in the
size order. n bytes have sqrt(2n) distinct sizes at most; where that is too
many, `bits` bounds the classes by their precision, and a class is scheduled by
its mean.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .numbering import numbered


def schedule(classes: list[tuple[int, float]], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strokes for (count, mean size) classes, largest size first.

    Returns the first group number of each stroke, how many shards take turns
    in it, and their order: the group with number i of stroke j goes to
    order[j, (i - first[j]) % turns[j]].
    """
    heap = [(0.0, k) for k in range(shards)]
    first, turns, order, at = [], [], [], 0
    for count, size in classes:
        while count:
            level = [heapq.heappop(heap)]
            while heap and heap[0][0] < level[0][0] + size:
                level.append(heapq.heappop(heap))
            m = len(level)
            rounds = max(1, int((heap[0][0] - level[-1][0]) // size)) if heap else -(-count // m)
            given = min(count, rounds * m)
            first.append(at)
            turns.append(m)
            order.append([k for _, k in level] + [0] * (shards - m))
            for i, (load, k) in enumerate(level):
                heapq.heappush(heap, (load + size * (given // m + (i < given % m)), k))
            at += given
            count -= given
    return np.array(first, np.int64), np.array(turns, np.int64), np.array(order, np.int16).reshape(-1, shards)


def assign(df: DataFrame, group: Column, size: Column, shards: int = 16, bits: int | None = None) -> DataFrame:
    """df with `size` long, `shard` int and `slot` long (gapless from 0 in each shard).

    group: rows that are equal here stay together (null is a value like any
    other). size: a row's load, at least 1. Repeated rows are rows of their
    own. An empty df gives an empty result. df needs doc_id for the order of
    slots; columns of the names of the result are replaced, all others stay.
    A group larger than an even share still stays whole: its shard then gets
    nothing else. Groups are scheduled by their exact totals; with `bits`, by
    classes of so many bits of precision.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c.lower() not in ("size", "shard", "slot")]
    # the columns of df travel in a struct, so no name of theirs can clash
    slim = cut(df.select(F.struct(*own).alias("_row_of"), group.alias("_key"), size.cast("long").alias("size")))
    groups = slim.groupBy("_key").agg(F.sum("size").alias("total"))
    shift = F.greatest(F.floor(F.log2("total")) - bits, F.lit(0)).cast("int") if bits else F.lit(0)
    groups = groups.withColumn("_class", F.call_function("shiftleft", F.call_function("shiftright", F.col("total"), shift), shift))
    ranked = cut(numbered(groups, [F.desc("_class"), F.desc("total"), F.col("_key")]))
    classes = ranked.groupBy("_class").agg(F.count("*").alias("n"), F.sum("total").alias("t")).collect()
    classes = [(r["n"], r["t"] / r["n"]) for r in sorted(classes, key=lambda r: -r["_class"])]
    plan = spark.sparkContext.broadcast(schedule(classes, shards))

    @F.pandas_udf("int")
    def shard_of(idx: pd.Series) -> pd.Series:
        first, turns, order = plan.value
        i = idx.to_numpy()
        j = np.searchsorted(first, i, "right") - 1
        return pd.Series(order[j, (i - first[j]) % turns[j]].astype(np.int32))

    placed = ranked.select(F.col("_key").alias("_k"), shard_of("idx").alias("shard"))
    rows = slim.join(placed, slim["_key"].eqNullSafe(placed["_k"])).select("_row_of", "size", "shard")
    out = numbered(rows, [F.col("_row_of.doc_id")], ["shard"], "slot")
    return out.select(*(F.col("_row_of")[c].alias(c) for c in own), "size", "shard", "slot")


def op7(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of assign() over documents: equal texts stay together, sizes come near equal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).alias("_n"), F.md5(F.col("text").cast("binary")).alias("_md5"))
    out = assign(slim, F.coalesce(F.col("_md5"), F.lit("none")), F.col("_n") + 1, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
