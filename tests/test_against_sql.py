"""Queries on odd tables against their SQL in DuckDB."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry


def both(spark, folder, name: str, tables: dict):
    """Rows of a query and of its SQL over the given tables, sorted."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    ours = entry.queries()[name](spark, str(folder))
    sql = db.execute(f"SELECT {', '.join(ours.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return tuple(sorted(map(tuple, rows), key=repr) for rows in (ours.collect(), sql))


DOC = "doc_id long, text string, lang string, source string"


def test_title_prefix_of_odd_documents(spark, tmp_path):
    texts = [" — led by a space", "  ", "", None, "One", "One  — two", "— dash first", "𠮷é — 二", "a\n b"]
    rows = [(10 * n + k, x, "en", source) for n, x in enumerate(texts) for k, source in enumerate(["web", "", None])]
    ours, sql = both(spark, tmp_path, "title_prefix", {"documents": spark.createDataFrame(rows, DOC)})
    assert len(sql) == 27 and ours == sql


def test_stream_job_changes_go_into_files_not_through_the_driver(spark, tmp_path):
    events = spark.range(60).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 7 as user_id", "if(id % 3 = 0, 'view', 'click') as event_type", "id / 10.0D as value", "'{}' as props")
    ours, sql = both(spark, tmp_path, "stream_job_changes", {"events": events})
    assert sql and ours == sql
    assert all(f.endswith(".parquet") for f in entry.queries()["stream_job_changes"](spark, str(tmp_path)).inputFiles())


def test_stream_job_changes_of_no_events(spark, tmp_path):
    none = spark.range(0).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id as user_id", "'' as event_type", "0D as value", "'' as props")
    assert both(spark, tmp_path, "stream_job_changes", {"events": none}) == ([], [])


def test_repair_calls_the_provider_once_a_batch_and_round(spark, tmp_path):
    import pandas as pd
    from pyspark.sql import functions as F

    from foliomill.operators import provider

    echo, log = "あ" * 30, str(tmp_path / "calls")

    def engine(p, strict):
        with open(log, "a") as f:
            f.write(f"{p['seg_id'].tolist()} {strict}\n")
        return pd.DataFrame({"seg_id": p["seg_id"], "translation": [x if i == "e" and not strict else None if i == "n" else "  " if i == "b" else "ok" for i, x in zip(p["seg_id"], p["text"])]})

    items = spark.createDataFrame([(1, "a", "x"), (1, "e", echo), (1, "n", "x"), (1, "b", "x"), (2, "z", None)], "batch int, seg_id string, text string")
    got = {r.seg_id: (r.translation, r.error) for r in provider.repair(items, engine).withColumn("k", F.lit(1)).collect()}
    bad = (None, "no usable answer")
    assert got == {"a": ("ok", None), "e": ("ok", None), "z": ("ok", None), "n": bad, "b": bad}
    calls = sorted(open(log).read().splitlines())
    assert len(calls) == 4 and "['z'] False" in calls and "['e', 'n', 'b'] True" in calls and "['n', 'b'] True" in calls
