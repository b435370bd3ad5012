"""Exact rolling medians and deviations (12): panes, runs, bisection of ranks.

Rows are points (series, time, value). Equal points are counted once with a
weight, in Spark, so a burst of one value at one time is one row. The stretches
of a window's length of each series are counted, and by these counts a series is
cut into slices of whole stretches and about equal numbers of points; a slice goes to
a task with the points that its windows reach back to, so a hot series is many tasks and a window never needs
another one. Where a stretch or the one before it holds very many points, slices are parts of
it; of the slices that lie whole within all windows of a slice its task
gets no points, but how often each value occurs in them.

In a task, points in time order are cut into short panes, and each pane is
sorted by value into a run once. A window is a stretch of whole panes and two
edge panes, of which only the points within the window count. A rank is
selected by bisection over all runs at once: each step probes one value and
counts how many points of the window are not above it. The position of every
value in every run is written down beforehand, summed over the runs, so the
whole panes of a window cost two look-ups however many they are; runs are never
merged. The deviations from a window's own median are counted in the same runs,
by the two values at a given distance from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ordering import number

from .common import cut

#: Points that a slice should hold, where a window holds fewer.
SLICE = 8_000
#: Points of a window's length from which on slices are shorter than it; how many there are to a window at most.
DENSE, PARTS = 100_000, 64
#: Rows about stretches up to which they are sent to all tasks; beyond that they meet the points by key.
SENT = 200_000
#: Entries of the table of positions that a step builds; windows that it selects for at once.
TABLE, WINDOWS = 1 << 22, 2048
#: Values of this size and more, and those that are no numbers, have no cents.
WIDEST = 1 << 58
_NONE = np.empty(0, np.int64)


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5) as a long; null for null, for NaN, and from 2**58 on, where a doubled distance would leave 64 bits."""
    x = F.floor(F.lit(100.0) * value + F.lit(0.5))
    return F.when(~F.isnan(value) & (F.abs(F.lit(100.0) * value) < F.lit(float(WIDEST))), x).cast("long")


class Panes:
    """Points in time order, in panes of equal length; each pane is a run sorted by value."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, always: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)):
        """always: values, each once, and their weights in every window besides its points."""
        n = len(values)
        self.values, ranks = np.unique(np.concatenate([values, always[0]]), return_inverse=True)
        own = np.zeros(len(self.values) + 1, np.int64)
        own[ranks[n:] + 1] = always[1]
        ranks = ranks[:n]
        self.size = size = max(int(n**0.5) // 2, 8, -(-n * len(self.values) // TABLE))
        panes, wide = max(1, -(-n // size)), len(self.values) + 1
        at = np.arange(n)
        order = np.lexsort((ranks, at // size))
        #: By pane and place in its run: rank, place in time, weight.
        self.ranks, self.times = np.full(panes * size, wide, np.int32), np.full(panes * size, -1, np.int32)
        self.weights = np.zeros(panes * size, np.int64)
        self.ranks[:n], self.times[:n], self.weights[:n] = ranks[order], order, weights[order]
        #: always[r]: the weight of values below rank r that every window holds.
        self.always = np.cumsum(own)
        self.ranks, self.times, self.weights = (x.reshape(panes, size) for x in (self.ranks, self.times, self.weights))
        self.plain = bool((weights == 1).all())
        #: below[p, r]: the weight of points in runs before p with a rank below r.
        below = np.zeros((panes + 1, wide), np.int32 if int(weights.sum()) < 1 << 31 else np.int64)
        np.add.at(below, (at // size + 1, ranks + 1), weights.astype(below.dtype))
        np.cumsum(below, axis=1, out=below)
        np.cumsum(below, axis=0, out=below)
        self.below, self.wide = below.ravel(), wide

    def windows(self, begin: np.ndarray, end: np.ndarray) -> Windows:
        return Windows(self, begin, end)


class Windows:
    """Some windows [begin, end) of places in time, over one Panes."""

    def __init__(self, panes: Panes, begin: np.ndarray, end: np.ndarray):
        self.panes, size = panes, panes.size
        first, last, begin, end = -(-begin // size), end // size, begin.astype(np.int32), end.astype(np.int32)
        inside = last < first  # within one pane: an edge alone
        self.low, self.high = first * panes.wide, np.maximum(first, last) * panes.wide
        left = np.maximum(first - 1, 0)
        right = np.minimum(last, len(panes.ranks) - 1)
        edge = lambda pane, some: np.where(some[:, None] & (panes.times[pane] >= begin[:, None]) & (panes.times[pane] < end[:, None]), panes.ranks[pane], np.int32(panes.wide))
        self.edges = np.hstack([edge(left, first * size > begin), edge(right, (last * size < end) & ~inside)])
        self.heavy = None if panes.plain else np.hstack([panes.weights[left], panes.weights[right]])

    def _edge(self, hit: np.ndarray, some) -> np.ndarray:
        return np.count_nonzero(hit, axis=1) if self.heavy is None else (hit * self.heavy[some]).sum(1)

    def _whole(self, rank: np.ndarray, some) -> np.ndarray:
        return self.panes.below[self.high[some] + rank] - self.panes.below[self.low[some] + rank] + self.panes.always[rank]

    def select(self, k: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The k-th (from 0) least value of each window in `some`."""
        edges = self.edges[some]
        low, high = np.zeros(len(some), np.int64), np.full(len(some), len(self.panes.values) - 1)
        for _ in range(int(len(self.panes.values) - 1).bit_length()):
            mid = (low + high) >> 1
            enough = self._whole(mid + 1, some) + self._edge(edges <= mid.astype(np.int32)[:, None], some) > k
            high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid + 1, high))
        return self.panes.values[low]

    def distances(self, centre: np.ndarray) -> None:
        """From now on, near() counts points by |2 * value - centre|."""
        values = np.append(self.panes.values, [0, 0])
        self.centre = centre
        self.far = np.where(self.edges < self.panes.wide, np.abs(2 * values[self.edges] - centre[:, None]), np.iinfo(np.int64).max)

    def near(self, k: np.ndarray, some: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The k-th (from 0) least distance of each window in `some`, which is `low` at least."""
        values, centre, far = self.panes.values, self.centre[some], self.far[some]

        def enough(t):
            above = np.searchsorted(values, (centre + t) >> 1, "right")
            below = np.searchsorted(values, -((t - centre) >> 1))
            return self._whole(above, some) - self._whole(below, some) + self._edge(far <= t[:, None], some) > k

        low, step = low.copy(), np.full(len(some), 64, np.int64)
        high = low + step
        open_ = ~enough(high)
        while open_.any():  # a bracket of doubling width
            low, step = np.where(open_, high + 1, low), np.where(open_, step * 8, step)
            high = np.where(open_, high + step, high)
            open_ &= ~enough(high)
        while (low < high).any():
            mid = low + ((high - low) >> 1)
            yes = enough(mid)
            high, low = np.where(yes, mid, high), np.where(yes, low, np.minimum(mid + 1, high))
        return low


def _both(select, n: np.ndarray) -> np.ndarray:
    """The sum of the two middle ranks; select(k, some, first) with what was found for the lower one."""
    every = np.arange(len(n))
    one = select((n - 1) // 2, every, None)
    two = one.copy()
    even = np.flatnonzero(n % 2 == 0)
    two[even] = select(n[even] // 2, even, one[even])
    return one + two


def medians(times: np.ndarray, values: np.ndarray, weights: np.ndarray, at: np.ndarray, reach: int, always: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)):
    """For each of the ascending times `at`: the weight in (at - reach, at], its doubled median and doubled median of |2 * value - median|; 0 where less than two. times ascend; always: values and weights that all windows hold besides."""
    begin, end = np.searchsorted(times, at - reach, "right"), np.searchsorted(times, at, "right")
    before = np.concatenate([[0], np.cumsum(weights)])
    n = before[end] - before[begin] + always[1].sum()
    median, spread = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    todo = np.flatnonzero(n >= 2)
    i = 0
    while i < len(todo):
        origin = begin[todo[i]]
        most = origin + max(2 * (end[todo[i]] - origin), WINDOWS)
        j = max(i + 1, int(np.searchsorted(end[todo], most, "right")))
        stop = end[todo[j - 1]]
        panes = Panes(values[origin:stop], weights[origin:stop], always)
        per = max(1, min(WINDOWS, (1 << 19) // panes.size))
        for a in range(i, j, per):
            own = todo[a : min(a + per, j)]
            w = panes.windows(begin[own] - origin, end[own] - origin)
            median[own] = m = _both(lambda k, some, _, w=w: w.select(k, some), n[own])
            w.distances(m)
            spread[own] = _both(lambda k, some, least, w=w: w.near(k, some, np.zeros(len(some), np.int64) if least is None else least), n[own])
        i = j
    return n, median, spread


def dealt(points: DataFrame, series: str, time: str, value: str, reach: int) -> DataFrame:
    """s, fine, slice, mine, t, v, w: the points that each slice needs for rolling(), `mine` where they lie in it, and, without t, weights of values that all its windows hold."""
    rows = points.where(F.col(time).isNotNull()).select(F.col(series).alias("s"), F.col(time).alias("t"), F.col(value).alias("v"))
    stretch = F.floor(F.col("t") / F.lit(reach)).cast("long")
    cells = cut(rows.groupBy("s", stretch.alias("o")).agg(F.count("*").alias("m")))
    most, count = cells.agg(F.coalesce(F.max("m"), F.lit(0)), F.count("*")).first()
    parts = int(min(PARTS, most // DENSE + 1))
    while reach % parts:  # the parts of a stretch are of equal length
        parts -= 1
    length = reach // parts
    by = Window.partitionBy("s").orderBy("o")
    next_to = lambda c, f, n: F.when(f("o").over(by) == F.col("o") + n, f(c).over(by))
    cells = cells.select("*", F.floor((F.sum("m").over(by) - F.col("m")) / SLICE).cast("long").alias("k"), (F.lit(parts > 1) & (F.greatest("m", F.coalesce(next_to("m", F.lag, -1), F.lit(0))) > DENSE)).alias("fine"))
    cells = cells.select(F.col("s").alias("_s"), "o", "k", "fine", next_to("k", F.lead, 1).alias("k1"), next_to("fine", F.lead, 1).alias("fine1"))
    counted = rows.groupBy("s", "t", "v").agg(F.count("*").alias("w"))
    counted = counted.join(F.broadcast(cells) if count <= SENT else cells, F.col("s").eqNullSafe(F.col("_s")) & (stretch == F.col("o")))
    own = F.floor(F.col("t") / F.lit(length)).cast("long")
    # the slice of a point, and that of the stretch, or part, after the windows' length, if there are windows
    to = F.array(F.struct("fine", F.when(F.col("fine"), own).otherwise(F.col("k")).alias("slice"), F.lit(True).alias("mine")), F.struct(F.col("fine1").alias("fine"), F.when(F.col("fine1"), own + parts).otherwise(F.col("k1")).alias("slice"), F.lit(False).alias("mine")))
    to = F.filter(to, lambda x: x["mine"] | (x["slice"].isNotNull() & ((x["fine"] != F.col("fine")) | (x["slice"] != F.col("k")) | F.col("fine"))))
    out = counted.select("s", F.inline(to), "t", "v", "w")
    if parts > 1:
        # a window of a part begins in the part `parts` before it, and holds those between whole
        between = counted.where(F.col("v").isNotNull() & (F.col("fine") | F.col("fine1"))).groupBy("s", "o", "fine", "fine1", own.alias("g"), "v").agg(F.sum("w").alias("w"))
        after = F.filter(F.sequence(F.col("g") + 1, F.col("g") + parts - 1), lambda j: F.when(F.floor(j / F.lit(parts)) == F.col("o"), F.col("fine")).otherwise(F.coalesce("fine1", F.lit(False))))
        between = between.select("s", F.explode(after).alias("slice"), "v", "w").groupBy("s", "slice", "v").agg(F.sum("w").alias("w"))
        out = out.union(between.select("s", F.lit(True), "slice", F.lit(False), F.lit(None).cast("long"), "v", "w"))
    return out


def rolling(points: DataFrame, series: str, time: str, value: str, reach: int) -> DataFrame:
    """series, time, n, median2, spread4 for each distinct (series, time) of points.

    points: series of any type, null being one of them; time and value (null:
    none) long. A window holds the values of its series with a time above its
    own minus `reach` and at most its own, all of those at its own time
    included, equal values each. median2 is the sum of the two middle values,
    or twice the only middle one; spread4 the same of |2 * value - median2|;
    both are null where n < 2. Rows without time are left out. An empty table
    gives no rows. A task holds one slice of a series and a window before it,
    each distinct (time, value) once: SLICE points, or as many as a window's length
    holds, up to DENSE; where that holds more, two slices of a PARTS-th of it
    and how often each value occurs in between.
    """
    slices = dealt(points, series, time, value, reach)
    kind = points.schema[series].dataType

    def task(key, group):
        whole = group.filter(group.column("t").is_null())
        group = group.filter(group.column("t").is_valid())
        always = whole.column("v").to_numpy(), whole.column("w").to_numpy()
        t = group.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        t = t[order]
        there = group.column("v").is_valid().to_numpy(zero_copy_only=False)[order]
        v, w = group.column("v").fill_null(0).to_numpy()[order], group.column("w").to_numpy()[order]
        at = np.unique(t[group.column("mine").to_numpy(zero_copy_only=False)[order]])
        n, median, spread = medians(t[there], v[there], w[there], at, reach, always)
        few = n < 2
        return pa.table([pa.repeat(key[0], len(at)), pa.array(at), pa.array(n), pa.array(median, mask=few), pa.array(spread, mask=few)], names=["s", "t", "n", "median2", "spread4"])

    out = slices.groupBy("s", "fine", "slice").applyInArrow(task, f"s {kind.simpleString()}, t long, n long, median2 long, spread4 long")
    return out.select(F.col("s").alias(series), F.col("t").alias(time), "n", "median2", "spread4")


def op12(clicks: DataFrame) -> DataFrame:
    """click_id, kind, n, median2, mad4, far for each click.

    Of rows that repeat a click_id (null is one id) the least by (time there,
    ts, kind, value) counts. Clicks without ts go, even if another row of the
    id had none. Other columns are ignored.
    """
    timed = clicks.select("click_id", number(clicks, "ts").alias("us"), "kind", "value")
    first = F.min(F.struct(F.col("us").isNull().alias("gone"), "us", "kind", "value"))
    once = timed.groupBy("click_id").agg(first.alias("r")).where("not r.gone")
    rows = once.select("click_id", F.col("r.kind").alias("kind"), F.col("r.us").alias("us"), cents(F.col("r.value")).alias("c"))
    got = rolling(rows, "kind", "us", "c", 3_600_000_000).select(F.col("kind").alias("_kind"), F.col("us").alias("_us"), "n", "median2", F.col("spread4").alias("mad4"))
    out = rows.join(got, F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("us") == F.col("_us")))
    far = 2 * F.abs(2 * F.col("c") - F.col("median2")) > 3 * F.col("mad4")
    return out.select("click_id", "kind", "n", "median2", "mad4", far.alias("far"))
