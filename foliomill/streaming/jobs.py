"""Streams over job events: changes by keyed state, and windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The table of that name in a folder, one file or a folder of them, as a stream; ts gets a zone, since watermarks need one.

    The name is written as a pattern, since a stream takes a plain path for a folder.
    """
    return spark.readStream.schema(EVENTS).parquet(f"{folder}/{{{name}}}").withColumn("ts", F.col("ts").cast("timestamp"))


def job_changes(stream: DataFrame) -> DataFrame:
    """Emit an event of a job only when (status, progress) differs from the last one emitted; the state is that pair."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        last = state.get if state.exists else None
        out = []
        for seq, status, progress in zip(rows["seq"], rows["status"], rows["progress"], strict=True):
            if (status, progress) != last:
                out.append((key[0], int(seq), status, float(progress)))
                last = (status, float(progress))
        state.update(last)
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "progress"])

    schema = "job_id long, seq long, status string, progress double"
    return stream.groupBy("job_id").applyInPandasWithState(step, schema, "status string, progress double", "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, terminal: tuple[str, ...] = ("done", "failed", "cancelled"), timeout_ms: int = 3_600_000) -> DataFrame:
    """A job's changes, and one end event: when it reaches a terminal status, or when nothing came for the timeout.

    job_id, event (progress or end), status, progress, reason (finished or timeout). Nothing follows an end. A query
    with processing-time timeouts runs until it is stopped, under any trigger.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, progress, ended = state.get if state.exists else (None, None, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], "end", status, progress, "timeout"))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for now, at in zip(rows["status"], rows["progress"], strict=True):
                if ended or (now, at) == (status, progress):
                    continue
                status, progress = now, float(at)
                out.append((key[0], "progress", status, progress, None))
                if status in terminal:
                    ended = True
                    out.append((key[0], "end", status, progress, "finished"))
            state.update((status, progress, ended))
            if not ended:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["job_id", "event", "status", "progress", "reason"])

    schema = "job_id long, event string, status string, progress double, reason string"
    return stream.groupBy("job_id").applyInPandasWithState(step, schema, "status string, progress double, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all input that is there. Appended rows go from the tasks into Parquet files in the folder of the checkpoint;
    the other modes, which files cannot take, end in a memory table, which the driver holds whole."""
    spark = stream.sparkSession
    out = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    rows = f"{checkpoint}/rows"
    q = out.format("parquet").option("path", rows).start() if mode == "append" else out.format("memory").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows) if mode == "append" else spark.table(name)
