"""Spans against spans, and sessions as spans.

overlap_join() places a span on a level by its length, so that it touches two
bins of its level at most, and again on every coarser level that the other side
uses. Two spans meet on the coarser of their levels, in the bin where the later
one starts: exactly once, however long they are. So the join is on equal
values; no pair is compared that doesn't share a bin. Where a side has few long
spans, these go into the several bins of a finer level instead, as a level of
their own would cost a copy of every row of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ordering import columns, no_clash, number

#: Bits by which the bins of a level are longer than those of the one below.
STEP = 2


def _levelled(df: DataFrame, by: list[str], start: str, end: str, name: str) -> DataFrame:
    """by, start and end (whole numbers), level and row of each span that isn't empty."""
    rows = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)), number(df, start).alias(f"{name}s"), number(df, end).alias(f"{name}e"), F.struct(*columns(df.columns)).alias(name))
    bits = F.length(F.bin(F.col(f"{name}e") - F.col(f"{name}s") - 1))  # 2**bits is the length at least
    rows = rows.where(F.col(f"{name}s") < F.col(f"{name}e")).withColumn(f"{name}l", F.ceil(bits / STEP).cast("int"))
    for i in range(len(by)):
        rows = rows.where(F.col(f"k{i}").isNotNull())
    return rows


def _targets(counts: dict[int, int], other: int, levels: list[int]) -> dict[int, int]:
    """The level that spans of each level go to: the next finer one of `levels`, again and again, while their bins there are fewer than the other side's rows."""
    target, bins = {x: x for x in counts}, dict(counts)
    for high, low in zip(levels, levels[1:]):
        n = bins.get(high, 0) << STEP * (high - low)
        if 0 < n <= other:
            bins[low] = bins.get(low, 0) + n
            target = {x: low if t == high else t for x, t in target.items()}
    return target


def _binned(rows: DataFrame, name: str, others: list[int]) -> DataFrame:
    """rows once for each bin (level, bin) they touch on their own level and on the coarser ones of `others`."""
    above = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col(f"{name}l"))
    levels = F.concat(F.array(f"{name}l"), above)
    bins = lambda x: F.transform(F.sequence(_bin(f"{name}s", x), _bin(f"{name}e - 1", x)), lambda b: F.struct(x.alias("level"), b.alias("bin")))
    return rows.select("*", F.inline(F.flatten(F.transform(levels, bins))))


def _moved(rows: DataFrame, level: str, target: dict[int, int]) -> DataFrame:
    moved = [(x, t) for x, t in target.items() if x != t]
    if not moved:
        return rows
    return rows.withColumn(level, F.coalesce(*(F.when(F.col(level) == x, F.lit(t)) for x, t in moved), F.col(level)))


def _bin(place: str, level: Column) -> Column:
    # floor also below zero
    return F.call_function("shiftright", F.expr(place), (level * STEP).cast("int"))


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], by: list[str] | None = None, b_by: list[str] | None = None) -> DataFrame:
    """Each pair of a row of a and a row of b whose spans [start, end) overlap and whose `by` columns are equal, once, with the columns of both.

    Spans are of timestamps, dates or whole numbers, both sides alike. Empty
    and reversed spans, and rows with a null start, end or key, match nothing;
    rows that repeat match each for themselves. Columns of one name on both
    sides raise. Spans may be of any length, also within one table.
    """
    by = by or []
    b_by = b_by or by
    no_clash(a.columns, b.columns)
    x, y = _levelled(a, by, *a_span, "a"), _levelled(b, b_by, *b_span, "b")
    # 32 counts a side at most
    present = lambda rows, name: {r[0]: r[1] for r in rows.groupBy(f"{name}l").count().collect()}
    in_a, in_b = present(x, "a"), present(y, "b")
    levels = sorted({*in_a, *in_b}, reverse=True)
    to_a, to_b = _targets(in_a, sum(in_b.values()), levels), _targets(in_b, sum(in_a.values()), levels)
    x, y = _moved(x, "al", to_a), _moved(y, "bl", to_b)
    x, y = _binned(x, "a", sorted({*to_b.values()})), _binned(y, "b", sorted({*to_a.values()}))
    keys = [*(f"k{i}" for i in range(len(by))), "level", "bin"]
    level = F.col("level")
    once = (F.greatest("al", "bl") == level) & (F.greatest(_bin("as", level), _bin("bs", level)) == F.col("bin"))
    pairs = x.join(y, keys).where((F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae")) & once)
    return pairs.select(*(F.col(f"a.`{c}`") for c in a.columns), *(F.col(f"b.`{c}`") for c in b.columns))


def sessions(df: DataFrame, by: list[str], time: str, gap: int, total: str | None = None) -> DataFrame:
    """by, started, ended (microseconds; the last row's), n and, if given, the sum `total` of a whole-number column, of each run of rows at most `gap` microseconds apart (as session_window has it).

    Rows are first counted in cells of the gap's length, all rows of which are
    of one session; only cells meet in a window, so a key with most of the rows
    brings no more than one row a cell. A null key is a key; rows without time
    are left out.
    """
    t = number(df, time)
    rows = df.select(*columns(by), t.alias("_t"), *([F.col(f"`{total}`").cast("long").alias("_v")] if total else [])).where(F.col("_t").isNotNull())
    sums = [F.sum("_v").alias("total")] if total else []
    cells = rows.groupBy(*columns(by), F.floor(F.col("_t") / gap).alias("_cell")).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("*").alias("n"), *sums)
    w = Window.partitionBy(*columns(by)).orderBy("_cell")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(w) > gap).cast("long"), F.lit(1))
    cells = cells.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(w))
    again = [F.sum("total").alias("total")] if total else []
    return cells.groupBy(*columns(by), "_session").agg(F.min("_first").alias("started"), F.max("_last").alias("ended"), F.sum("n").alias("n"), *again).drop("_session")
