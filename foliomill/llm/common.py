"""Helpers shared by the corpus operators: the shared scratch folder, settled tables and Arrow streaming."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a folder of its own; a cluster has none to fall back on.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or f"{tempfile.gettempdir()}/checkpoints/{os.getuid()}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/foliomill-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliomill_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a settled table that nothing will read again."""
    path = getattr(df, "_foliomill_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as empty text, so it falls in fold 0 (held out)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5).cast("int")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream that is sorted by integer key columns at key changes.

    Yields (rows, starts): whole groups only, starts holding the first row of each group and the row count at the end.
    A group that spans several batches is carried over, so memory is one batch plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last, first = [held[-1].column(k)[-1].as_py() for k in keys], [batch.column(k)[0].as_py() for k in keys]
            tail = [batch.column(k)[-1].as_py() for k in keys]
            if last == first == tail:  # one group goes through the whole batch
                held.append(batch)
                continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = _starts(rows, keys)
        cut = int(starts[-2])
        if cut:
            yield rows.slice(0, cut).combine_chunks(), starts[:-1]
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, _starts(rows, keys)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def utf8(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that no plan refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
