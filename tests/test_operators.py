import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliomill.functions import text as t
from foliomill.operators import golden, jobs, layout, provider, quality, render, review, sequence, terms
from foliomill.operators import segments as seg


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- segments --------------------------------------------------------------------------------------------------------


def test_units_of_a_table(spark):
    b = spark.createDataFrame([("d", 1, "b000001", "paragraph", " ", None), ("d", 7, "b000007", "table", "", [["名前", "値"], ["アル", ""]]), ("d", 8, "b000008", "image", "", None), ("d", 9, "b000009", "heading", "x", None)], "doc_id string, ord int, block_id string, type string, text string, rows array<array<string>>")
    assert [(r.unit_id, r.unit_ord) for r in seg.units(b).orderBy("unit_ord").collect()] == [("b000007:r0c0", 2), ("b000007:r0c1", 3), ("b000007:r1c0", 4), ("b000009", 6)]


def test_reimport_shifts_ids(spark):
    mk = lambda xs: spark.createDataFrame([(f"d:b{i}", x) for i, x in enumerate(xs)], "seg_id string, text string").withColumn("text_hash", t.text_hash("text"))
    got = dict(rows(seg.reimport(mk(["a", "b", "c"]), mk(["new", "a", " c  ", "d"]))))
    assert got == {"d:b0": "updated", "d:b1": "updated", "d:b2": "unchanged", "d:b3": "created"}
    old = mk(["a", "b"]).withColumns({"status": F.lit("done"), "translation": F.lit("x"), "final": F.lit("y")})
    got = {r.seg_id: (r.status, r.translation, r.final, r.orphan) for r in seg.upsert(old, mk(["a "])).collect()}
    assert got == {"d:b0": ("done", "x", "y", False), "d:b1": ("done", "x", "y", True)}


def test_carry_over_across_documents(spark):
    rows_ = [("a", 1, "雨が上がる。", "ja", "done"), ("a", 2, "夜が来た。", None, "done"), ("b", 1, "雨が上がる。", "ja", "pending"), ("b", 2, "夜が来た。", None, "pending"), ("b", 3, "夜が来た。", "", "pending"), ("b", 4, "雨が上がる。", "ja", "done")]
    s = spark.createDataFrame(rows_, "doc_id string, ord int, text string, source_lang string, status string").withColumn("text_hash", t.text_hash("text"))
    memory = seg.memory_of(s.filter("doc_id = 'a'").withColumn("translation", F.concat(F.lit("T"), F.col("ord").cast("string"))))
    got = {r.ord: r.translation for r in seg.carry_over(s.filter("doc_id = 'b'"), memory).collect()}
    assert got == {1: "T1", 3: "T2"}  # a null language meets nothing, a finished segment is left alone
    assert seg.carry_over(s.filter("doc_id = 'b'"), memory, "en").count() == 0


def test_search_wildcards(spark):
    s = spark.createDataFrame([("1", "done", "50% off"), ("2", "done", "500 off"), ("3", "pending", "50% Off")], "seg_id string, status string, text string")
    assert [r[0] for r in rows(seg.search(s, "50%O", literal=False), "seg_id")] == ["1", "2", "3"]
    assert [r[0] for r in rows(seg.search(s, "50% o", "done", literal=True), "seg_id")] == ["1"]


def test_record(spark):
    s = spark.createDataFrame([("1", None, "f", "pending", 0, None), ("2", "old", None, "done", 1, None), ("3", None, None, "pending", 0, None)], "seg_id string, translation string, final string, status string, attempts int, last_error string")
    r = spark.createDataFrame([("1", "t", None), ("2", None, "e" * 600)], "seg_id string, translation string, error string")
    got = {x.seg_id: (x.translation, x.final, x.status, x.attempts, len(x.last_error or "")) for x in seg.record(s, r).collect()}
    assert got == {"1": ("t", "f", "done", 1, 0), "2": ("old", None, "failed", 2, 500), "3": (None, None, "pending", 0, 0)}


# --- quality ---------------------------------------------------------------------------------------------------------

PAIRS = [
    ("1", "レムは笑った。", "蕾姆笑了。", "done"), ("2", "未訳です。", "", "failed"), ("3", "レムは笑った。", "レムは笑った。", "done"), ("4", "彼は行った。", "他は走了。", "done"),
    ("5", "レムが来た。", "她来了。", "done"), ("6", "長い長い長い文章です。", "短", "done"), ("7", "ドアを開けた。", "打开了ドア。", "done"), ("8", "第七章 『Reweave』", "第七章 『Reweave』", "done"),
    ("9", "待ち", "", "pending"), ("10", "一行文字です。", "們這是文字。", "done"), ("11", "１", "一。", "done"),
]


def test_quality_rules(spark):
    p = spark.createDataFrame(PAIRS, "seg_id string, source string, target string, status string")
    got = sorted(rows(quality.issues(p, [("レム", "蕾姆")])))
    assert got == sorted([("2", "untranslated", "error"), ("3", "source_leak", "error"), ("4", "kana_left", "error"), ("5", "term_missing", "error"), ("6", "length_anomaly", "warn"), ("7", "katakana_left", "warn"), ("9", "untranslated", "warn"), ("10", "traditional", "warn")])
    assert quality.passed(quality.issues(p)).first().ok is False
    assert ("2", "empty") in rows(quality.judge(p)) and ("3", "untranslated") in rows(quality.judge(p))


# --- sequences -------------------------------------------------------------------------------------------------------


def test_chapters_drop_other_headings(spark):
    data = [(1, "paragraph", None, "preface", "main"), (2, "heading", 1, "表紙", "cover"), (3, "heading", 1, "第一章", "main"), (4, "paragraph", None, "a", "main"), (5, "heading", 2, "sub", "main"), (6, "paragraph", None, "x", "colophon"), (7, "heading", 1, " ", "main"), (8, "heading", 1, "第二章", "afterword"), (9, "paragraph", None, "b", "main")]
    b = spark.createDataFrame([("d", o, f"b{o}", k, lv, x, m, bool(x.strip())) for o, k, lv, x, m in data], "doc_id string, ord int, block_id string, type string, level int, text string, matter string, translatable boolean")
    got = rows(sequence.chapters(b).select("ord", "chapter", "title"), "ord")
    assert got == [(1, 0, "（前言）"), (3, 1, "第一章"), (4, 1, "第一章"), (5, 1, "第一章"), (8, 2, "第二章"), (9, 2, "第二章")]


@pytest.mark.parametrize(("sizes", "chars", "items", "want"), [([100] * 10, 250, 24, [2] * 5), ([1] * 10, 2400, 3, [3, 3, 3, 1]), ([5000], 2400, 24, [1]), ([10, 5000, 10], 2400, 24, [1, 1, 1])])
def test_batches(spark, sizes, chars, items, want):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(sizes)], "doc_id string, ord int, n int")
    got = rows(sequence.batches(df, chars, items), "ord")
    assert [o for _, o, _ in got] == list(range(len(sizes)))
    assert pd.Series([b for _, _, b in got]).value_counts(sort=False).tolist() == want


def test_context_and_guard(spark):
    s = spark.createDataFrame([("d", c, f"s{c}") for c in range(1, 7)], "doc_id string, chapter int, summary string")
    assert rows(sequence.previous_context(s, 2), "chapter")[3] == ("d", 4, "s2\ns3")
    asked = spark.createDataFrame([("d", 9), ("d", 1)], "doc_id string, chapter int")
    assert rows(sequence.context_for(asked, s, 2)) == [("d", 9, "s5\ns6")]
    c = spark.createDataFrame([("d", i, 0.4) for i in range(5)], "doc_id string, batch int, cost double")
    assert [r.batch for r in sequence.cost_guard(c, 1.0).orderBy("batch").collect()] == [0, 1, 2]
    i = spark.createDataFrame([("a", 1, "main", "x.jpg"), ("a", 2, "main", "cover.jpg"), ("b", 1, "main", "cover.jpg"), ("b", 2, "cover", "y.jpg"), ("c", 1, "main", "z.jpg")], "doc_id string, ord int, matter string, path string")
    assert dict(rows(sequence.pick_cover(i))) == {"a": "cover.jpg", "b": "y.jpg"}


# --- terms and golden ------------------------------------------------------------------------------------------------


def test_terms(spark):
    texts = ["レムはスバルと「氷上決戦」を見た。", "レムとレム。コーヒーを飲む。", "レムが笑う", "スバルとレム、スバル。自分の世界。"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], "doc_id string, ord int, text string")
    got = {r.term: (r.n, r.kind) for r in terms.candidates(df, 1).collect()}
    assert got["レム"] == (5, "katakana") and got["氷上決戦"] == (2, "quoted") and "コーヒー" not in got and "自分" not in got
    assert [r.term for r in terms.top_terms(df, 3).collect()] == ["レム", "スバル"]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcda"), ("", ""), ("abc", "xyz")], "a string, b string")
    assert [r.x for r in df.select(golden.quick_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 1.0, 0.0]
    assert [round(r.x, 2) for r in df.select(golden.sequence_ratio("a", "b").alias("x")).collect()] == [0.75, 1.0, 0.0]


# --- layout ----------------------------------------------------------------------------------------------------------


def chars(spark, text, heights, page=0):
    return spark.createDataFrame([("d", page, i, c, 0.0, 0.0, 10.0, float(h), 12.0) for i, (c, h) in enumerate(zip(text, heights, strict=True))], "doc_id string, page int, pos int, ch string, x0 double, y0 double, x1 double, y1 double, h double")


@pytest.mark.parametrize(
    ("text", "heights", "want"),
    [("難がたい", [12, 6, 6, 12], "難い"), ("却って", [12, 7.4, 12], "却って"), ("学び舎\nや\nとして", [12, 12, 12, 0, 6, 0, 12, 12, 12], "学び舎\n\nとして"), ("あやう", [12, 6, 12], "あやう"), ("手て強ごわい", [12, 6, 12, 6, 6, 12], "手強い")],
)
def test_ruby(spark, text, heights, want):
    kept = layout.strip_ruby(chars(spark, text, heights)).orderBy("pos").collect()
    assert "".join(r.ch for r in kept) == want


def test_direction_and_height(spark):
    moves = spark.createDataFrame([("v", 0.5, -16.2), ("v", 0.1, -15.0), ("h", 12.4, 0.2), ("z", 0.0, 0.0)], "doc_id string, dx double, dy double")
    assert dict(rows(layout.vertical(moves))) == {"v": True, "h": False, "z": False}
    boxes = spark.createDataFrame([("d", 0.0, h) for h in (14.0, 16.0, 14.0, 100.0, 0.1)] + [("e", 0.0, 0.2)], "doc_id string, y0 double, y1 double")
    assert dict(rows(layout.char_height(boxes, ["doc_id"]))) == {"d": 16.0, "e": 12.0}


def page(spark, data):
    return spark.createDataFrame([("d", p, r, x, 0.0, float(y), 60.0, 10.0) for p, r, x, y in data], "doc_id string, page int, row int, text string, off double, y double, x double, h double")


def test_headers_and_page_numbers(spark):
    body = [(p, r, f"body line {p} {r}", 700 - 12 * r) for p in range(20) for r in range(1, 30)]
    extra = [(p, 0, "Running Head", 760) for p in range(12)] + [(p, 99, str(p + 1), 42) for p in range(20)] + [(3, 50, "lonely", 20)]
    rows_ = page(spark, body + extra)
    assert rows(layout.running_heads(layout.margin_rows(rows_), layout.page_counts(rows_))) == [("d", "Running Head", 12)]
    assert rows(layout.page_number_rows(rows_)) == [("d", 5, 20)]
    left = {r.text for r in layout.without_headers(rows_).collect()}
    assert "Running Head" not in left and "7" not in left and "lonely" in left and len(left) == len(body) + 1


def test_paragraphs(spark):
    data = [(0, 1, "One trans-", 0.0), (0, 2, "lation here", 0.0), (0, 3, "Two", 14.0), (0, 4, "", 0.0), (1, 1, "goes on", 0.0)]
    df = spark.createDataFrame([("d", p, r, x, off) for p, r, x, off in data], "doc_id string, page int, row int, text string, off double")
    assert [r.text for r in layout.paragraphs(df).orderBy("para").collect()] == ["One translation here", "Two goes on"]


# --- review, rendering, jobs, provider -------------------------------------------------------------------------------


def test_review_round_trip(spark):
    s = spark.createDataFrame([("1", "d", 1, "done", "src\tx", "a\nb", None), ("2", "d", 2, "done", "s", "t", "f")], "seg_id string, doc_id string, ord int, status string, source string, translation string, final string")
    lines = [r.line for r in review.export_lines(s).orderBy("ord").collect()]
    assert lines == ["1\tdone\tsrc\\tx\ta\\nb", "2\tdone\ts\tf"]
    edited = [review.HEADER, "# note", lines[0], lines[1].replace("\tf", "\tnew"), "9\tdone\ts\tx", "2\tdone\ts\t ", "2\tdone"]
    parsed = review.parse_lines(spark.createDataFrame(list(enumerate(edited)), "line_no int, line string"))
    done = review.classify(parsed, s)
    assert [r.result for r in done.orderBy("line_no").collect()] == ["unchanged", "updated", "unknown", "blank", "unknown"]
    after = review.apply_edits(s, done)
    assert {r.seg_id: (r.final, r.status) for r in after.collect()} == {"1": (None, "done"), "2": ("new", "reviewed")}
    assert {r.seg_id: (r.final, r.status) for r in review.clear(after).collect()} == {"1": (None, "done"), "2": (None, "done")}


def test_target_mode_leaves_out_untranslated(spark):
    b = spark.createDataFrame([("d", 1, "b1", "heading", 1, "T<1>", None), ("d", 2, "b2", "paragraph", None, "p", None), ("d", 3, "b3", "paragraph", None, "q", None)], "doc_id string, ord int, block_id string, type string, level int, text string, rows array<array<string>>")
    tr = spark.createDataFrame([("d", "b2", "P&"), ("d", "b3", " ")], "doc_id string, block_id string, tgt string")
    assert render.chapters(b, tr, "target").first().body == "<h1>T&lt;1&gt;</h1><p>P&amp;</p>"
    assert spark.range(1).select(render.note_marks(F.array(F.lit("n1"))).alias("x")).first().x == '<sup><a href="#n1" class="noteref">[1]</a></sup>'


def test_jobs(spark):
    e = spark.createDataFrame([(1, 1, "running", 0.1, 5), (1, 2, "running", 0.1, 5), (1, 3, "running", 0.2, 5), (2, 4, "done", 1.0, 6)], "job_id long, seq long, status string, progress double, pid long")
    assert [r.seq for r in jobs.changes(e).orderBy("seq").collect()] == [1, 3, 4]
    assert rows(jobs.reap(jobs.current(e), spark.createDataFrame([(9,)], "pid long")).select("job_id", "status")) == [(1, "failed")]
    want = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    assert dict(rows(jobs.cancel(jobs.current(e), want))) == {1: "cancelled", 2: "refused", 3: "missing"}


@pytest.mark.parametrize(
    ("content", "want"),
    [('{"translations":[{"id":"a","text":"x"},{"text":"y"}]}', ["x"]), ('```json\n[{"id":"a","text":"x"}]\n```', ["x"]), ('[{"id":"a","text":"1"},{"id":"a","text":"2"}]', ["1", "2"]), ("not json", None), ('{"other":1}', None)],
)
def test_parse_response(spark, content, want):
    got = spark.range(1).select(F.transform(provider.parse_response(F.lit(content)), lambda i: i["text"]).alias("x")).first().x
    assert got == want


def test_repair(spark):
    def engine(p, strict):
        return pd.DataFrame({"seg_id": p["seg_id"], "translation": ["ok" if strict or s != "2" else "" for s in p["seg_id"]]}).query("seg_id != '3'")

    items = spark.createDataFrame([(0, "1", "x"), (0, "2", "y"), (0, "3", "z")], "batch int, seg_id string, text string")
    assert sorted(rows(provider.repair(items, engine)), key=str) == sorted([("1", "ok", None), ("2", "ok", None), ("3", None, "no usable answer")], key=str)


def test_similarity_query_compares_whole_texts(spark, tmp_path):
    from difflib import SequenceMatcher

    from foliomill.plans.all import QUERIES
    from foliomill.sources.tables import pairs

    long = "abc def " * 80
    rows = [(1, k, "user", text) for k, text in enumerate([long + "xyz" * 60, long, "short", long + "tail of another kind " * 9, long + "uvw " * 40, long + "q"], 3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.seg_id: r.ratio for r in QUERIES["similarity"](spark, str(tmp_path)).collect()}
    want = {r.seg_id: SequenceMatcher(None, r.source, r.target, autojunk=False).ratio() for r in pairs(spark, str(tmp_path)).collect()}
    assert got == want and any(0.5 < x < 1 for x in want.values())


def test_output_stem_query_reads_past_what_is_dropped(spark, tmp_path):
    from foliomill.plans.all import QUERIES

    spark.createDataFrame([(1, "/" * 250 + "Title")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["output_stem"](spark, str(tmp_path)).first().stem == "Title"


def test_nearest_takes_whole_long_texts(spark):
    long = "word " * 60
    rows = [(1, "a", long + "abc"), (1, "b", long + "abd"), (1, "c", long + "xyz"), (1, "d", "short"), (2, "e", long + "abc"), (1, "f", "")]
    df = spark.createDataFrame(rows, "doc_id long, id string, text string")
    best = {r.a_id: (r.b_id, r.score) for r in golden.nearest(df, df, "doc_id").collect()}
    n = len(long) + 3
    assert best["a"] == ("b", round((n - 1) / n, 6)) and best["b"] == ("a", round((n - 1) / n, 6)) and best["c"][0] in ("a", "b")
    assert best["d"] == ("f", 0.0) and "e" not in best


def test_nearest_writes_no_pairs_and_crosses_ranges(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(golden, "RANGE", 50)
    letters = ["abcde", "xyz", "あいう", "𠮷é"]
    a = [(k % 2, f"a{k}", (letters[k % 4] * 40)[: 13 * k % 121]) for k in range(24)]
    b = [(k % 2, f"b{k}", (letters[k * 7 % 4] * 40)[: 11 * k % 113]) for k in range(24)] * 2
    want = {}
    for key, i, x in a:
        for other, k, y in b:
            if key == other and abs(len(x) - len(y)) <= 40:
                n = len(x) + len(y)
                score = round(2 * sum((Counter(x) & Counter(y)).values()) / n, 6) if n else 1.0
                want[i] = min(want.get(i, (0.0, "z")), (-score, k))
    schema = "doc_id long, id string, text string"
    got = golden.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "doc_id")
    assert {r.a_id: (-r.score, r.b_id) for r in got.collect()} == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_in_blocks_is_nearest_at_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = sorted(("ab" * (k % 5) + "c" * (k % 7) for k in range(60)), key=len)
    group = pa.RecordBatch.from_pydict({"n": [len(x) for x in text], "id": [f"{k % 50}" for k in range(60)], "text": text, "left": [True] * 60, "right": [True] * 60})
    whole = [np.asarray(c).tolist() for c in golden._nearest_in(group, 3)]
    monkeypatch.setattr(golden, "BLOCK", 12)
    assert [np.asarray(c).tolist() for c in golden._nearest_in(group, 3)] == whole


def test_fragments_are_found_among_paragraphs(spark):
    df = spark.createDataFrame([(1, "a", "b" * 300), (1, "b", "b" * 299), (2, "c", "b" * 299), (1, "d", "z")], "doc_id long, id string, text string")
    assert [r.id for r in golden.fragments(df, df, ["doc_id"]).collect()] == ["b"]


def test_strip_ruby_deals_rows_once(spark):
    rows = [(1, 1, k, c, 0.0, h, 12.0) for k, (c, h) in enumerate([("あ", 6.0), (" ", 6.0), ("い", 8.0), ("x", 6.0), ("う", 8.0), ("え", 6.0), ("学", 12.0), ("お", 12.0), ("か", 6.0), (" ", 6.0), ("学", 12.0)])]
    got = layout.strip_ruby(spark.createDataFrame(rows, "doc_id int, page int, pos int, ch string, y0 double, y1 double, h double"))
    assert [r.ch for r in got.orderBy("pos").collect()] == [" ", "x", "学", "お", " ", "学"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
