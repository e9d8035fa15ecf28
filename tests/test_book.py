import time

import pandas as pd

from foliomill.operators import segments as seg
from foliomill.plans import book
from foliomill.streaming import jobs as stream

BLOCK = "doc_id string, block_id string, ord int, type string, level int, text string, matter string, source_lang string, rows array<array<string>>"


def blocks(spark, texts, doc="d"):
    rows = [(doc, f"b{n:06d}", n, "heading" if n == 1 else "paragraph", 1, x, "main", "ja", None) for n, x in enumerate(texts, 1)]
    return spark.createDataFrame(rows, BLOCK)


def engine():
    """A provider; a nested function, since workers cannot import this file."""

    def run(p, strict):
        return pd.DataFrame({"seg_id": p["seg_id"], "translation": ["" if "bad" in x else f"tr {x}" for x in p["text"]]})

    return run


def test_a_book_from_import_to_output(spark):
    first = book.import_blocks(blocks(spark, ["Title", "one", "  ", "bad", "two"])).cache()
    assert sorted(r.status for r in first.collect()) == ["pending"] * 4
    done = book.translate(first, engine()).cache()
    assert {r.text: (r.status, r.translation) for r in done.collect()} == {"Title": ("done", "tr Title"), "one": ("done", "tr one"), "bad": ("failed", None), "two": ("done", "tr two")}
    assert [(r.seg_id, r.kind, r.severity) for r in book.check(done).collect()] == [("d:b000004", "untranslated", "error")]
    body = book.render_books(blocks(spark, ["Title", "one", "  ", "bad", "two"]), done, "target").first().body
    assert body == "<h1>Title</h1><p>tr one</p><p>tr two</p>"
    again = book.import_blocks(blocks(spark, ["Title", "one ", "  ", "good", "two"]), old=done).cache()
    assert {r.text.strip(): r.status for r in again.collect()} == {"Title": "done", "one": "done", "good": "pending", "two": "done"}


def test_memory_serves_another_book(spark):
    memory = seg.memory_of(book.translate(book.import_blocks(blocks(spark, ["x", "same"])), engine()))
    other = book.import_blocks(blocks(spark, ["same", "new"], "e"), memory=memory)
    assert {r.text: (r.status, r.translation) for r in other.collect()} == {"same": ("done", "tr same"), "new": ("pending", None)}


def test_watch_ends_once(spark, tmp_path):
    rows = [(1, 1, "running", 0.1), (1, 2, "running", 0.1), (1, 3, "done", 1.0), (1, 4, "running", 0.5), (2, 5, "running", 0.3)]
    spark.createDataFrame(rows, "job_id long, seq long, status string, progress double").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("job_id long, seq long, status string, progress double").parquet(str(tmp_path / "in"))
    # processing-time timeouts keep a query running for ever, so it is stopped once the rows are there
    q = stream.watch(events).writeStream.format("memory").queryName("watch_once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.time() + 90
    while time.time() < end and spark.table("watch_once").count() < 4:
        time.sleep(1)
    q.stop()
    got = spark.table("watch_once").collect()
    assert sorted((r.job_id, r.event, r.status, r.reason) for r in got) == [(1, "end", "done", "finished"), (1, "progress", "done", None), (1, "progress", "running", None), (2, "progress", "running", None)]
