import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.functions import text as t


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  a　b\tc ", "a b c"), ("a\x0bb", "ab"), ("a b　　c", "a b c"), (None, ""), ("　", ""), ("x\r\ny", "x y")],
)
def test_normalize_ws(spark, raw, want):
    assert one(spark, t.normalize_ws(F.lit(raw))) == want


def test_small_scalars(spark):
    assert one(spark, t.ligatures(F.lit("eﬃcient ﬁre ſo"))) == "efficient fire so"
    assert one(spark, t.strip_soft(F.lit("a­b​c﻿"))) == "abc"
    assert one(spark, t.squeeze_cjk(F.lit("「── 星が 悪 かった"))) == "「──星が悪かった"
    assert one(spark, t.squeeze_cjk(F.lit("英語 abc の 混在"))) == "英語 abc の混在"
    assert one(spark, t.estimate_tokens(F.lit(""))) == 1 and one(spark, t.estimate_tokens(F.lit("abcd"))) == 2
    assert one(spark, t.mask_secret(F.lit("0123456789"))) == "*" * 10
    assert one(spark, t.mask_secret(F.lit("sk-abcdefghijkl"))) == "sk-abc******ijkl"
    assert one(spark, t.output_stem(F.lit('Re:zero / "a" <b>. '), F.lit("d1"))) == "Re：zero ＂a＂ ＜b＞"
    assert one(spark, t.output_stem(F.lit(" /. "), F.lit("d1"))) == "d1"
    assert one(spark, t.slugify(F.lit("Re：ゼロから始める異世界生活 43 (MF文庫J)"))) == "Re-ゼロから始める異世界生活-43-MF文庫J"[:28].rstrip("-")
    assert one(spark, t.slugify(F.lit("!!"))) == "book"
    assert one(spark, t.typeset_escape(F.lit("a#b\n- c"))) == "a\\#b\n\\- c"
    assert one(spark, t.strip_fences(F.lit("```json\n[1]\n```"))) == "[1]"
    assert one(spark, t.without_rt(F.lit("<ruby>幕<rt>まく</rt>間<rt>あい</rt></ruby> x"))) == "幕間 x"
    assert one(spark, t.upper_median(F.array(*[F.lit(x) for x in (14.0, 16.0, 14.0, 100.0)]))) == 16.0
    assert one(spark, t.effective_text(F.lit(""), F.lit("m"))) == "m"


@pytest.mark.parametrize(
    ("a", "b", "vertical", "want"),
    [("trans-", "lation", False, "translation"), ("日本", "語", False, "日本語"), ("the quick", "brown", False, "the quick brown"), ("a-", "B", False, "a- B"), ("a", "b", True, "ab"), ("", "b", False, "b"), ("a", "", False, "a"), ("-", "x", False, "- x")],
)
def test_join_wrapped(spark, a, b, vertical, want):
    assert one(spark, t.join_wrapped(F.lit(a), F.lit(b), vertical)) == want


@pytest.mark.parametrize(
    ("path", "title", "want"),
    [("p-allcover-001", "", "back"), ("p-cover", "", "cover"), ("p-toc-001", "", "toc"), ("p-colophon2", "", "colophon"), ("p-bookwalker", "", "promo"), ("p-001", "", "main"), ("", "あとがき", "afterword"), ("", " 目次 ", "toc"), ("x", "第一章", "main")],
)
def test_matter(spark, path, title, want):
    assert one(spark, t.classify_matter(F.lit(path), F.lit(title))) == want


@pytest.mark.parametrize(("text", "want"), [("12", True), ("１２３", True), ("xiv", True), ("12345", False), ("a1", False), (" 7 ", True), ("", False)])
def test_page_number(spark, text, want):
    assert one(spark, t.is_page_number(F.lit(text))) is want


@pytest.mark.parametrize(("a", "b", "n", "want"), [("レムは 笑った", "レムは笑った", 0, True), ("「────」", "「────」", 0, False), ("べ", "べ", 20, False), ("レム", "蕾姆", 0, False)])
def test_untranslated(spark, a, b, n, want):
    assert one(spark, t.is_untranslated(F.lit(a), F.lit(b), n)) is want


@pytest.mark.parametrize(("dy", "want"), [(0.0, "cont"), (2.8, "cont"), (8.4, "start"), (14.7, "start"), (78.0, "inner")])
def test_segment_kind(spark, dy, want):
    assert one(spark, t.segment_kind(F.lit(dy), F.lit(14.2))) == want


def test_cost(spark):
    cost = lambda m, tier: one(spark, t.estimate_cost(F.lit(1_000_000), F.lit(1_000_000), F.lit(m), F.lit(tier)))
    assert (cost("flash", "idle"), cost("pro", "peak"), cost("other", "idle"), cost("pro", "local")) == (5.0, 36.0, 5.0, 0.0)


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab\\\t\n\rtnr é日", max_size=12), min_size=1, max_size=20))
def test_tsv_round_trip(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for r in df.select("x", t.tsv_escape("x").alias("e")).select("x", "e", t.tsv_unescape("e").alias("back")).collect():
        assert r.back == r.x and not set(r.e) & set("\t\n\r")


def test_normalize_ws_looks_before_it_replaces(spark):
    from foliomill.functions import fixed as X

    marks = [chr(c) for c in [*range(0x20), 0x20, 0x7F, 0x85, 0xA0, 0xA1, 0x1680, *range(0x1FFF, 0x2030), 0x202F, 0x205F, 0x2FFF, 0x3000, 0x3001, 0xFEFF, 0x1F600]]
    texts = [x for m in marks for x in (m, f"a{m}b", f" {m}a", f"a{m} ", f"a {m} b", f"{m}{m}a")] + ["", " ", "a  b", "  a b  ", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    both = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("x", F.lit("")), f"[{X.CONTROL}]", ""), f"[{X.WS}]+", " "))
    assert df.filter(t.normalize_ws("x") != both).collect() == []
    plan = df.select(t.normalize_ws("x").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
