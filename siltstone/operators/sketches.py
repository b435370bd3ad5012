"""Mergeable summaries: distinct counts by HyperLogLog, quantiles by KLL, kept by part and merged, never counted again.

A summary row holds the number of rows and two sketches of bounded size. It is
made in one aggregate whose partial results are sketches, too, so a hot group
costs a sketch a task. Summaries of parts merge to that of the whole, in any
order. With the sizes here distinct counts are exact up to some thousand values
and then have a standard error of 0.8% (1.04 / sqrt(2**14)); a quantile's rank is
off by 1.65% at most in 99 of 100 cases.

Where distinct counts must be exact and keys are whole numbers that lie densely,
bitmaps do: a row for each group and each 32,768 keys in a row, of 4 KB, merged
by OR. Keys far apart cost 4 KB each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordering import columns

#: Size of a HyperLogLog sketch (2**LG registers) and of a KLL sketch.
LG, K = 14, 200


def summarize(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """by, n, keys, values: a summary of each group; null keys and values are in n only."""
    text = F.col(f"`{key}`").cast("string")
    number = F.col(f"`{value}`").cast("double")
    return df.groupBy(*columns(by)).agg(F.count("*").alias("n"), F.hll_sketch_agg(text, F.lit(LG)).alias("keys"), F.kll_sketch_agg_double(number, F.lit(K)).alias("values"))


def merge(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of larger groups from those of their parts."""
    return summaries.groupBy(*columns(by)).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("values").alias("values"))


def estimates(summaries: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The groups with n, distinct (estimate) and quantiles (array, as asked for; null without values)."""
    there = F.kll_sketch_get_n_double("values") > 0
    quantiles = F.when(there, F.array(*(F.kll_sketch_get_quantile_double("values", F.lit(float(q))) for q in at)))
    return summaries.select("*", F.hll_sketch_estimate("keys").alias("distinct"), quantiles.alias("quantiles")).drop("keys", "values")


def bitmaps(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, bucket, ids: which whole-number keys each group has; null keys are in a bucket of their own and not counted."""
    k = F.col(f"`{key}`").cast("long")
    return df.groupBy(*columns(by), F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("ids"))


def merge_bitmaps(parts: DataFrame, by: list[str]) -> DataFrame:
    """Bitmaps of larger groups from those of their parts."""
    return parts.groupBy(*columns(by), "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def distinct(parts: DataFrame, by: list[str]) -> DataFrame:
    """by and distinct, exact, from bitmaps."""
    return parts.groupBy(*columns(by)).agg(F.sum(F.bitmap_count("ids")).alias("distinct"))
