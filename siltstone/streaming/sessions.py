"""Sessions of an event stream by event time, with a watermark.

State lives between micro-batches and restarts: the open sessions of each key.
A session is written once the watermark has passed its end. Rows that are later
than the watermark when their batch starts are dropped, and counted.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.commits import Folder
from siltstone.operators.ordering import columns, number


def sessions(events: DataFrame, by: list[str], time: str, gap: str, delay: str, total: str | None = None) -> DataFrame:
    """by, started, ended (microseconds; the last row's), n and the sum `total` of sessions of a stream, or of a table.

    A session's rows are at most `gap` apart. The watermark follows the
    greatest time of the batches before by `delay`. A null key is a key; rows
    without time are in no session.
    """
    rows = events.select(*columns(by), F.timestamp_micros(number(events, time)).alias("_at"), *([F.col(f"`{total}`").alias("_v")] if total else []))
    sums = [F.sum("_v").alias("total")] if total else []
    grouped = rows.withWatermark("_at", delay).groupBy(F.session_window("_at", gap).alias("_w"), *columns(by))
    out = grouped.agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("n"), *sums)
    return out.select(*columns(by), F.unix_micros("_first").alias("started"), F.unix_micros("_last").alias("ended"), "n", *(["total"] if total else []))


@dataclass
class Progress:
    """What a run did: batches with rows, rows read, rows dropped as late, open sessions left, watermark (ISO text or None)."""

    batches: int = 0
    rows: int = 0
    late: int = 0
    open: int = 0
    watermark: str | None = None


def _late_rows(spark: SparkSession, checkpoint: str, schema, time: str, gap: str, batch: dict) -> int:
    """Rows of a batch whose session of their own had ended by the watermark of the batch before, which is what the state goes by. It counts rows of one key and time as one itself, by task."""
    mark = json.loads(Folder(spark, f"{checkpoint}/offsets").read(str(batch["batchId"] - 1)).splitlines()[1])["batchWatermarkMs"]
    source = batch["sources"][0]
    # offsets come as a dictionary or its text, with one number; none before the first batch
    first, last = (int(m[0]) if (m := re.search(r"-?\d+", str(source[o]))) else -1 for o in ("startOffset", "endOffset"))
    log = Folder(spark, f"{checkpoint}/sources/0")
    names, files = set(log.names()), []
    for n in range(first + 1, last + 1):
        entries = map(json.loads, log.read(f"{n}.compact" if f"{n}.compact" in names else str(n)).splitlines()[1:])
        files += [unquote(e["path"]) for e in entries if e["batchId"] == n]
    rows = spark.read.schema(schema).parquet(*files)
    ended = F.timestamp_micros(number(rows, time)) + F.expr(f"INTERVAL '{gap}'")
    return rows.where(F.unix_micros(ended) <= mark * 1000).count()


def progress(query: StreamingQuery, late=None) -> Progress:
    """The totals of a query that has ended; its batches must fit spark.sql.streaming.numRecentProgressUpdates.

    late: the late rows of a batch's progress, called where the state dropped
    any; without it, rows of one key and time count as one in a task.
    """
    out = Progress()
    for p in query.recentProgress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        out.batches += p["numInputRows"] > 0
        out.rows += p["numInputRows"]
        for s in p["stateOperators"]:
            dropped = s["numRowsDroppedByWatermark"]
            out.late += late(p) if late and dropped else dropped
            out.open = s["numRowsTotal"]
        out.watermark = p["eventTime"].get("watermark") or out.watermark
    return out


def append_sessions(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, by: list[str], time: str, gap: str, delay: str, total: str | None = None, files_per_batch: int | None = None) -> Progress:
    """Read all new Parquet files of `folder`, append the sessions that have ended to `out`, keep the open ones in `checkpoint`, and return.

    Call it again when more files have come: it goes on where it stopped, and a
    run that was lost is made good without losing or repeating a session.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    made = sessions(reader.parquet(folder), by, time, gap, delay, total)
    query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return progress(query, lambda p: _late_rows(spark, checkpoint, schema, time, gap, p))


def close(spark: SparkSession, folder: str, schema, time: str, at: str = "9000-01-01") -> None:
    """Add a row of nulls with a time far ahead to `folder`, so that the next append_sessions() ends all open sessions but that row's own. All later rows will be late."""
    fields = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*fields).write.mode("append").parquet(folder)
