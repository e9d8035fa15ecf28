"""Jobs, event windows, streams and the provider loop."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import functions as F

from foliomill.operators import jobs, provider, segments as seg
from foliomill.sources.glossary import parse_lines
from foliomill.sources.tables import job_events, pairs, table, tenths
from foliomill.streaming import jobs as stream

from .registry import JOB, PAIR, query

_run = itertools.count()


@query(JOB + "SELECT job_id, seq, status, progress FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM job) WHERE n = 1")
def job_current(spark, sf):
    return jobs.current(job_events(spark, sf)).select("job_id", "seq", "status", "progress")


_CHANGE = JOB + ", c AS (SELECT *, lag(status) OVER w AS ls, lag(progress) OVER w AS lp, row_number() OVER w AS n FROM job WINDOW w AS (PARTITION BY job_id ORDER BY seq))"


@query(_CHANGE + "SELECT job_id, seq, status, progress FROM c WHERE n = 1 OR status <> ls OR progress <> lp")
def job_changes(spark, sf):
    return jobs.changes(job_events(spark, sf)).select("job_id", "seq", "status", "progress")


@query(JOB + """, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM job) WHERE n = 1)
SELECT job_id, 'failed' AS status FROM cur WHERE status IN ('view', 'click') AND pid NOT IN (1, 2, 3, 5, 8)""")
def job_reap(spark, sf):
    alive = spark.createDataFrame([(p,) for p in (1, 2, 3, 5, 8)], "pid long")
    return jobs.reap(jobs.current(job_events(spark, sf)), alive, ("view", "click")).select("job_id", "status")


@query(JOB + """, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM job) WHERE n = 1), w AS (SELECT DISTINCT job_id * 2 AS job_id FROM job)
SELECT w.job_id, CASE WHEN cur.status IS NULL THEN 'missing' WHEN cur.status IN ('purchase', 'error') THEN 'refused' ELSE 'cancelled' END AS outcome FROM w LEFT JOIN cur USING (job_id)""")
def job_cancel(spark, sf):
    e = job_events(spark, sf)
    wanted = e.select((F.col("job_id") * 2).alias("job_id")).distinct()
    return jobs.cancel(jobs.current(e), wanted, ("purchase", "error"))


@query(JOB + "SELECT job_id, seq, status FROM job ORDER BY ts DESC, seq DESC LIMIT 50")
def recent_jobs(spark, sf):
    return job_events(spark, sf).orderBy(F.desc("ts"), F.desc("seq")).limit(50).select("job_id", "seq", "status")


@query(JOB + "SELECT job_id, arg_max(status, seq) AS status, max(seq) AS seq FROM job WHERE status NOT IN ('purchase', 'error') GROUP BY job_id")
def latest_active(spark, sf):
    e = job_events(spark, sf).filter("status not in ('purchase', 'error')")
    return seg.latest(e, "job_id", "seq").select("job_id", "status", "seq")


@query("SELECT event_id, 'event: progress' || chr(10) || 'data: {\"status\":\"' || event_type || '\",\"job\":' || user_id || '}' || chr(10) || chr(10) AS body FROM events")
def sse_events(spark, sf):
    body = jobs.sse("progress", F.struct(F.col("event_type").alias("status"), F.col("user_id").alias("job")))
    return table(spark, sf, "events").select("event_id", body.alias("body"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.tumbling(e, "1 hour").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT b AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS b FROM events) GROUP BY b""")
def events_sliding(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sliding(e, "1 hour", "15 minutes").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sessions(e, "30 minutes").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(_CHANGE + "SELECT job_id, seq, status, progress FROM c WHERE n = 1 OR status <> ls OR progress <> lp")
def stream_job_changes(spark, sf):
    """The change stream over all events that are there, by keyed state; equal to job_changes."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    name = f"job_changes_{spark.sparkContext.applicationId}_{next(_run)}".replace("-", "_")
    events = stream.read_events(spark, sf)
    shaped = events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), tenths(F.col("value")).alias("progress"))
    return stream.run_once(stream.job_changes(shaped), name, "append", f"{folder}/streams/{name}")


# --- provider --------------------------------------------------------------------------------------------------------


@query(PAIR + "SELECT seg_id, CASE WHEN turn % 9 <> 0 THEN '[tr]' || source END AS translation, CASE WHEN turn % 9 = 0 THEN 'simulated failure' END AS error FROM pair")
def fake_translate(spark, sf):
    return provider.fake(pairs(spark, sf).select("seg_id", F.col("source").alias("text"), (F.col("turn") % 9 == 0).alias("fails")))


@query(PAIR + "SELECT seg_id, CASE WHEN turn % 3 = 2 THEN NULL ELSE target END AS text FROM pair")
def response_parse(spark, sf):
    item = F.struct(F.col("seg_id").alias("id"), F.col("target").alias("text"))
    bare, wrapped = F.to_json(F.array(item)), F.to_json(F.struct(F.array(item).alias("translations")))
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(F.col("turn") % 3 == 1, bare).otherwise(F.concat(F.lit("sorry "), "target"))
    return pairs(spark, sf).select("seg_id", F.get(provider.parse_response(content), 0)["text"].alias("text"))


@query(PAIR + "SELECT seg_id, CASE WHEN turn % 4 = 3 THEN NULL ELSE target END AS translation, CASE WHEN turn % 4 = 3 OR trim(target) = '' THEN 'missing' END AS error FROM pair")
def response_join(spark, sf):
    p = pairs(spark, sf).withColumn("batch", F.col("conv_id"))
    answers = p.filter("turn % 4 <> 3").groupBy("batch").agg(F.to_json(F.collect_list(F.struct(F.col("seg_id").alias("id"), F.col("target").alias("text")))).alias("content"))
    return provider.answers(p.select("batch", "seg_id"), answers).select("seg_id", "translation", "error")


@query(PAIR + "SELECT seg_id, CASE WHEN turn % 10 <> 9 THEN 'tr ' || source END AS translation, CASE WHEN turn % 10 = 9 THEN 'no usable answer' END AS error FROM pair")
def repair_rounds(spark, sf):
    def engine(p: pd.DataFrame, strict: bool) -> pd.DataFrame:
        def answer(seg_id: str, text: str | None) -> str | None:
            turn = int(seg_id.split(":")[1])
            if not strict and turn % 3 == 0:
                return text if text is not None and len(text) >= 60 else ""
            return "" if turn % 10 == 9 else None if text is None else "tr " + text

        text = [answer(*x) for x in zip(p["seg_id"], p["text"], strict=True)]
        return pd.DataFrame({"seg_id": p["seg_id"], "translation": text})

    items = pairs(spark, sf).select(F.col("conv_id").alias("batch"), "seg_id", F.col("source").alias("text"))
    return provider.repair(items, engine)


@query(PAIR + """SELECT conv_id AS batch, '[' || string_agg('{"id":' || to_json(seg_id) || ',"text":' || to_json(source) || '}', ',' ORDER BY turn) || ']' AS payload FROM pair GROUP BY conv_id""")
def batch_payload(spark, sf):
    return provider.payload(pairs(spark, sf).select(F.col("conv_id").alias("batch"), F.col("turn").alias("ord"), "seg_id", F.col("source").alias("text")))


@query(PAIR + """SELECT conv_id AS batch, count(*) AS calls, CAST(sum(CASE WHEN turn % 2 = 0 THEN floor(length(source) / 2) ELSE turn END) AS BIGINT) AS tokens_in, CAST(sum(floor(length(target) / 2)) AS BIGINT) AS tokens_out FROM pair GROUP BY conv_id""")
def usage_totals(spark, sf):
    n = F.when(F.col("turn") % 2 == 0, 0).otherwise(F.col("turn"))
    return provider.usage(pairs(spark, sf).select(F.col("conv_id").alias("batch"), n.alias("tokens_in"), F.lit(0).alias("tokens_out"), F.col("source").alias("prompt"), F.col("target").alias("answer")))


@query(PAIR + "SELECT seg_id, CASE WHEN length(source) > 150 AND length(target) < length(source) THEN target ELSE source END AS summary FROM pair")
def summary_budget(spark, sf):
    return pairs(spark, sf).select("seg_id", provider.accept_compression(F.col("source"), F.col("target"), F.lit(100)).alias("summary"))


_LINES = ["# note", "レム=蕾姆", "source\tcount\tkind\tsample\ttranslation", "スバル\t12\tkatakana\tx\t昴", " a = b ", "レム=雷姆", "empty=", "only\t\t", "エミリア\t愛蜜莉雅"]


@query("SELECT * FROM (VALUES (1, 'レム', '雷姆'), (2, 'スバル', '昴'), (3, 'a', 'b'), (4, 'エミリア', '愛蜜莉雅')) g(gl_order, term, expected)")
def glossary_parse(spark, sf):
    return parse_lines(spark.createDataFrame(list(enumerate(_LINES)), "line_no int, line string"))
