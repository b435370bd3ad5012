"""Registered queries over time: as-of joins, spans, sessions; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators.asof import asof_join
from siltstone.operators.intervals import overlap_join, sessions
from siltstone.operators.ordering import number
from siltstone.operators.shared import drop_path, new_path
from siltstone.streaming.sessions import append_sessions, close

GAP = 30 * 60 * 1_000_000


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asof_events_orders(spark, sf_dir):
    """Each event with its user's latest order."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return asof_join(e, o, ["user_id"], "ts", "o_orderdate", tie=["o_orderkey"])


def asof_clicks_changes(spark, sf_dir):
    """Each click with its client's state: the latest change at or before it."""
    c = _t(spark, sf_dir, "clicks").select("click_id", "client_id", "ts")
    h = _t(spark, sf_dir, "client_changes").select("client_id", "valid_at", "change_id", "op", "segment", "balance")
    return asof_join(c, h, ["client_id"], "ts", "valid_at", tie=["change_id", "op", "segment", "balance"])


def asof_next_sale(spark, sf_dir):
    """Clicks with the client's next sale within six hours after them."""
    c = _t(spark, sf_dir, "clicks").select("click_id", "client_id", "ts")
    s = _t(spark, sf_dir, "sales").select("client_id", "sold_at", "sale_id")
    return asof_join(c, s, ["client_id"], "ts", "sold_at", direction="forward", strict=True, tolerance=6 * 3_600_000_000, tie=["sale_id"], how="inner")


def _sessions(spark, sf_dir):
    return sessions(_t(spark, sf_dir, "clicks"), ["client_id"], "ts", GAP)


def click_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("client_id", "started", "ended", "n")


def interval_sessions_sales(spark, sf_dir):
    """Sessions, open for half an hour after their last click, against the half hours after the sales of the client."""
    a = _sessions(spark, sf_dir).select("client_id", "started", (F.col("ended") + GAP).alias("closed"))
    s = _t(spark, sf_dir, "sales").select(F.col("client_id").alias("buyer"), "sale_id", F.unix_micros(F.col("sold_at").cast("timestamp")).alias("sold"))
    b = s.withColumn("until", F.col("sold") + GAP)
    return overlap_join(a, b, ("started", "closed"), ("sold", "until"), ["client_id"], ["buyer"]).select("client_id", "started", "sale_id", "sold")


def interval_journeys(spark, sf_dir):
    """Sessions of a client while a sale of theirs was on its way, from seconds to days."""
    a = _sessions(spark, sf_dir).select("client_id", "started", (F.col("ended") + GAP).alias("closed"))
    s = _t(spark, sf_dir, "sales").select(F.col("client_id").alias("buyer"), "sale_id", "sold_at", "arrived_at")
    return overlap_join(a.select("client_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("closed").alias("closed")), s, ("started", "closed"), ("sold_at", "arrived_at"), ["client_id"], ["buyer"]).select("client_id", F.unix_micros("started").alias("started"), "sale_id")


RANGES = 4


def _streamed(spark, sf_dir):
    """Where the sessions of clicks lie, and what each run did: the clicks come in RANGES equal ranges of their arrival, each read by a run of its own."""
    c = _t(spark, sf_dir, "clicks").select("client_id", "ts", "arrived_at").withColumn("_a", number(_t(spark, sf_dir, "clicks"), "arrived_at"))
    ends = c.agg(F.min("_a"), F.max("_a")).first()
    low, width = ends[0] or 0, max(1, (ends[1] or 0) - (ends[0] or 0))
    at, runs = new_path(spark, "click-sessions"), []
    schema = c.select("client_id", "ts").schema
    which = F.least(F.lit(RANGES - 1), F.floor((F.col("_a") - low) * RANGES / F.lit(width)))
    run = lambda: append_sessions(spark, f"{at}/in", schema, f"{at}/out", f"{at}/state", ["client_id"], "ts", "30 minutes", "10 minutes")
    for i in range(RANGES):
        c.where(which == i).select("client_id", "ts").write.mode("append").parquet(f"{at}/in")
        runs.append(run())
    close(spark, f"{at}/in", schema, "ts")
    runs.append(run())
    for done in ("in", "state"):
        drop_path(spark, f"{at}/{done}")
    return f"{at}/out", runs


def stream_click_sessions(spark, sf_dir):
    """Sessions of the clicks as they arrived, those that came more than ten minutes late left out where the watermark says so."""
    return spark.read.schema("client_id long, started long, ended long, n long").parquet(_streamed(spark, sf_dir)[0])


def stream_late_clicks(spark, sf_dir):
    """How many clicks each run read and how many of them it dropped as late, as it reports itself."""
    out, runs = _streamed(spark, sf_dir)
    drop_path(spark, out)
    return spark.createDataFrame([(i, r.rows, r.late) for i, r in enumerate(runs[:RANGES])], "run int, n long, late long")


QUERIES = (asof_events_orders, asof_clicks_changes, asof_next_sale, click_sessions, interval_sessions_sales, interval_journeys, stream_click_sessions, stream_late_clicks)

_SESSIONS = """
o AS (SELECT client_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM clicks WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY ts)),
i AS (SELECT client_id, ts, sum(opens) OVER (PARTITION BY client_id ORDER BY ts) AS s FROM o),
s AS MATERIALIZED (SELECT client_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM i GROUP BY client_id, s)
"""

#: Clicks by range of arrival, and whether they came after the watermark, which stands ten minutes before the latest click of the ranges before.
_ARRIVED = f"""
c AS MATERIALIZED (SELECT client_id, ts, least({RANGES - 1}, floor((epoch_us(arrived_at) - low) * {RANGES} / wide)) AS r FROM clicks, (SELECT epoch_us(min(arrived_at)) AS low, greatest(1, epoch_us(max(arrived_at)) - low) AS wide FROM clicks)),
x AS (SELECT r, max(ts) AS top FROM c GROUP BY r),
m AS (SELECT r, date_trunc('milliseconds', (SELECT max(top) FROM x y WHERE y.r < x.r)) - INTERVAL '10 minutes' AS mark FROM x),
l AS MATERIALIZED (SELECT client_id, ts, r, coalesce(ts + INTERVAL '30 minutes' <= mark, false) AS late FROM c JOIN m USING (r))
"""

def _ranges() -> str:
    """Sessions range by range, as a run has them: those of before that were still open and the clicks that are not late make new ones, of which those that the watermark has passed are final (done); a later click starts another session beside them, however near."""
    steps = []
    for r in range(RANGES):
        held = f" UNION ALL SELECT client_id, s, e, n FROM t{r - 1} WHERE NOT done" if r else ""
        done = f"coalesce(max(e) + INTERVAL '30 minutes' <= (SELECT date_trunc('milliseconds', max(top)) - INTERVAL '10 minutes' FROM x WHERE r <= {r}), false)" if r < RANGES - 1 else "true"
        steps.append(f"""
a{r} AS (SELECT client_id, ts AS s, ts AS e, 1 AS n FROM l WHERE r = {r} AND NOT late AND ts IS NOT NULL{held}),
b{r} AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY client_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM a{r}),
g{r} AS (SELECT *, sum(opens) OVER (PARTITION BY client_id ORDER BY s, e) AS g FROM b{r}),
t{r} AS MATERIALIZED (SELECT client_id, min(s) AS s, max(e) AS e, sum(n) AS n, {done} AS done FROM g{r} GROUP BY client_id, g)""")
    return ",".join(steps)


_WRITTEN = " UNION ALL ".join(f"SELECT * FROM t{r} WHERE done" for r in range(RANGES))

SQL = {
    "asof_events_orders": """
SELECT event_id, e.user_id AS user_id, ts, o_orderdate, o_orderkey, o_orderstatus FROM events e ASOF LEFT JOIN
(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""",
    "asof_clicks_changes": """
SELECT click_id, c.client_id AS client_id, ts, valid_at, change_id, op, segment, balance FROM clicks c ASOF LEFT JOIN
(SELECT * FROM client_changes QUALIFY row_number() OVER (PARTITION BY client_id, valid_at ORDER BY change_id DESC, op DESC, segment DESC NULLS LAST, balance DESC NULLS LAST) = 1) h ON c.client_id = h.client_id AND c.ts >= h.valid_at""",
    "asof_next_sale": """
SELECT click_id, c.client_id AS client_id, ts, sold_at, sale_id FROM clicks c ASOF JOIN
(SELECT * FROM sales QUALIFY row_number() OVER (PARTITION BY client_id, sold_at ORDER BY sale_id DESC) = 1) s ON c.client_id = s.client_id AND c.ts < s.sold_at WHERE sold_at - ts <= INTERVAL '6 hours'""",
    "click_sessions": f"WITH {_SESSIONS} SELECT client_id, started, ended, n FROM s",
    "stream_click_sessions": f"WITH {_ARRIVED}, {_ranges()} SELECT client_id, epoch_us(s) AS started, epoch_us(e) AS ended, CAST(n AS BIGINT) AS n FROM ({_WRITTEN})",
    "stream_late_clicks": f"WITH {_ARRIVED} SELECT CAST(k AS INTEGER) AS run, count(r) AS n, count(*) FILTER (late) AS late FROM range({RANGES}) q(k) LEFT JOIN l ON r = k GROUP BY k",
    "interval_sessions_sales": f"""
WITH {_SESSIONS}, b AS (SELECT client_id, sale_id, epoch_us(sold_at) AS sold FROM sales)
SELECT s.client_id AS client_id, started, sale_id, sold FROM s JOIN b ON s.client_id = b.client_id AND started < sold + {GAP} AND sold < ended + {GAP}""",
    "interval_journeys": f"""
WITH {_SESSIONS}, b AS (SELECT client_id, sale_id, epoch_us(sold_at) AS sold, epoch_us(arrived_at) AS arrived FROM sales WHERE sold_at < arrived_at)
SELECT s.client_id AS client_id, started, sale_id FROM s JOIN b ON s.client_id = b.client_id AND started < arrived AND sold < ended + {GAP}""",
}
