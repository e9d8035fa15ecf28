"""Jobs as a log of events: current state, changes, and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .segments import latest

TERMINAL = ("done", "failed", "cancelled")


def current(events: DataFrame) -> DataFrame:
    return latest(events, "job_id", "seq")


def changes(events: DataFrame) -> DataFrame:
    """Events whose (status, progress) differs from the one before."""
    w = W.partitionBy("job_id").orderBy("seq")
    snap = F.struct("status", "progress")
    e = events.withColumn("snap", snap).withColumn("last", F.lag("snap").over(w))
    return e.filter(~F.col("snap").eqNullSafe(F.col("last"))).drop("snap", "last")


def reap(jobs: DataFrame, alive: DataFrame, running: tuple[str, ...] = ("running",)) -> DataFrame:
    """Running jobs whose process is not alive, as failed."""
    return jobs.filter(F.col("status").isin(*running)).join(alive, "pid", "left_anti").withColumn("status", F.lit("failed"))


def cancel(jobs: DataFrame, wanted: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Every wanted job with what its request does: cancelled, refused (already at an end) or missing."""
    j = wanted.join(jobs, "job_id", "left")
    return j.select("job_id", F.when(F.col("status").isNull(), "missing").when(F.col("status").isin(*terminal), "refused").otherwise("cancelled").alias("outcome"))


def sse(event: str, payload: Column) -> Column:
    """A server-sent event of a struct."""
    return F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(payload), F.lit("\n\n"))


def recency(files: DataFrame) -> DataFrame:
    """files: (project, name, bytes, mtime). project, files, bytes and last change, newest first."""
    return files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("mtime").alias("mtime")).orderBy(F.desc("mtime"), "project")
