"""Scalar functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import fixed as X
from foliomill.functions import text as t
from foliomill.sources.tables import HIRAGANA_FROM, HIRAGANA_TO, blocks, pairs, segments, table

from .registry import BLOCK, PAIR, SEGMENT, WS, bare, hash24, kana, matter, norm, page_number, query, quoted, re2


@query(f"SELECT doc_id, {norm("replace(text, ' ', ' ' || chr(12288) || chr(9))")} AS clean FROM documents")
def norm_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.normalize_ws(F.replace("text", F.lit(" "), F.lit(" 　\t"))).alias("clean"))


@query(SEGMENT + "SELECT seg_id, text_hash FROM segment")
def text_hash(spark, sf):
    return segments(spark, sf).select("seg_id", "text_hash")


_edge = re2(X.CJK_EDGE)
_squeeze = lambda x: f"regexp_replace({x}, '([{_edge}])[ \\x{{3000}}]+([{_edge}])', '\\1\\2', 'g')"


@query(f"SELECT conv_id, turn, {_squeeze(_squeeze(kana('text')))} AS squeezed FROM conversations")
def cjk_squeeze(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.squeeze_cjk(F.translate("text", HIRAGANA_FROM, HIRAGANA_TO)).alias("squeezed"))


@query("SELECT doc_id, replace(replace(text, 'fi', chr(64257)), chr(64257), 'fi') AS plain, CAST(length(replace(text, 'fi', chr(64257))) AS INTEGER) AS n FROM documents")
def ligatures(spark, sf):
    tied = F.replace("text", F.lit("fi"), F.lit("ﬁ"))
    return table(spark, sf, "documents").select("doc_id", t.ligatures(tied).alias("plain"), F.length(tied).alias("n"))


@query(BLOCK + f"SELECT doc_id, ord, {matter('path_hint', 'text')} AS matter FROM block")
def matter_class(spark, sf):
    return blocks(spark, sf).select("doc_id", "ord", t.classify_matter("path_hint", "text").alias("matter"))


_slug = "regexp_replace(regexp_replace(trim(text), '[^0-9A-Za-z\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT doc_id, coalesce(nullif(regexp_replace(substr({_slug}, 1, 28), '-+$', ''), ''), 'book') AS slug FROM documents")
def slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.slugify("text").alias("slug"))


_short = "CASE WHEN ord % 3 = 0 THEN CAST(ord AS VARCHAR) WHEN ord % 3 = 1 THEN 'xiv' ELSE substr(text, 1, 4) END"


@query(BLOCK + f"SELECT doc_id, ord, {page_number(_short)} AS is_number FROM block")
def page_number_flag(spark, sf):
    short = F.when(F.col("ord") % 3 == 0, F.col("ord").cast("string")).when(F.col("ord") % 3 == 1, "xiv").otherwise(F.substring("text", 1, 4))
    return blocks(spark, sf).select("doc_id", "ord", t.is_page_number(short).alias("is_number"))


_tokens = "greatest(1, CAST(floor(length(coalesce(text, '')) / 1.5) AS INTEGER))"


@query(f"""
WITH x AS (SELECT conv_id, turn, {_tokens} AS n, CASE turn % 3 WHEN 0 THEN 'flash' WHEN 1 THEN 'pro' ELSE 'other' END AS model,
           CASE turn % 4 WHEN 0 THEN 'peak' WHEN 1 THEN 'local' ELSE 'idle' END AS tier FROM conversations)
SELECT conv_id, turn, n AS tokens, round(CASE WHEN tier = 'local' THEN 0.0 ELSE
  (n / 1e6 * CASE model WHEN 'pro' THEN 4.5 ELSE 1.0 END + n / 1e6 * CASE model WHEN 'pro' THEN 13.5 ELSE 4.0 END) * CASE WHEN tier = 'peak' THEN 2.0 ELSE 1.0 END END, 10)::DOUBLE AS cost FROM x
""")
def token_cost(spark, sf):
    n = t.estimate_tokens("text")
    model = F.when(F.col("turn") % 3 == 0, "flash").when(F.col("turn") % 3 == 1, "pro").otherwise("other")
    tier = F.when(F.col("turn") % 4 == 0, "peak").when(F.col("turn") % 4 == 1, "local").otherwise("idle")
    return table(spark, sf, "conversations").select("conv_id", "turn", n.alias("tokens"), F.round(t.estimate_cost(n, n, model, tier), 10).alias("cost"))


_esc = "replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"


@query(f"SELECT doc_id, {_esc} AS escaped, text AS back FROM documents")
def tsv_escape(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", t.tsv_escape("text").alias("escaped"))
    return d.select("doc_id", "escaped", t.tsv_unescape("escaped").alias("back"))


_untranslated = f"({bare('source')} <> '' AND {bare('source')} = {bare('target')} AND length({bare('source')}) >= 20 AND regexp_matches(source, '[{X.KANA}]'))"


@query(PAIR + f"SELECT seg_id, {_untranslated} AS flag FROM pair")
def untranslated_flag(spark, sf):
    return pairs(spark, sf).select("seg_id", t.is_untranslated("source", "target", 20).alias("flag"))


_stem = f"regexp_replace(translate(regexp_replace(regexp_replace(substr(text, 1, 200), '[\\x00-\\x1f]', '', 'g'), '[/\\\\]', '', 'g'), {quoted(X.STEM_FROM)}, {quoted(X.STEM_TO)}), '[{WS}]+', ' ', 'g')"
_ends = "'^[ .]+|[ .]+$', '', 'g'"


@query(f"SELECT doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace({_stem}, {_ends}), 1, 80), {_ends}), ''), CAST(doc_id AS VARCHAR)) AS stem FROM documents")
def output_stem(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.output_stem("text", "doc_id").alias("stem"))


@query("SELECT page_id, CASE WHEN length(url) <= 10 THEN repeat('*', length(url)) ELSE substr(url, 1, 6) || '******' || right(url, 4) END AS masked FROM pages")
def mask_secret(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.mask_secret("url").alias("masked"))


@query(PAIR + "SELECT seg_id, CASE WHEN turn % 2 = 0 AND target <> '' THEN target WHEN source <> '' THEN source ELSE '' END AS effective FROM pair")
def effective_text(spark, sf):
    final = F.when(F.col("turn") % 2 == 0, F.col("target")).otherwise("")
    return pairs(spark, sf).select("seg_id", t.effective_text(final, "source").alias("effective"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<rt\\b[^>]*>.*?</rt>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '[" + WS + "]+', ' ', 'g')) AS plain, len(regexp_extract_all(html, '(?i)<rt\\b')) AS rubies FROM pages")
def markup_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.without_rt("html").alias("plain"), F.regexp_count("html", F.lit(r"(?i)<rt\b")).cast("long").alias("rubies"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '([\\\\#$*_`@<>\\[\\]~])', '\\\\\\1', 'g'), '(?m)^([-+/=])', '\\\\\\1', 'g') AS escaped FROM documents")
def typeset_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.typeset_escape("text").alias("escaped"))


@query(PAIR + f"SELECT seg_id, length({bare('target')}) / nullif(length({bare('source')}), 0)::DOUBLE AS ratio, greatest(80, CAST(floor(length(source) / greatest(1, turn)) AS INTEGER)) AS budget FROM pair")
def ratio_and_budget(spark, sf):
    p = pairs(spark, sf)
    return p.select("seg_id", t.length_ratio("source", "target").alias("ratio"), t.chapter_budget(F.length("source"), F.col("turn")).alias("budget"))


@query("SELECT event_id, greatest(0.2, least(0.8, 0.2 + 0.6000000000000001 * least(1.0, greatest(0.0, value / 50)))) AS shown FROM events")
def progress_band(spark, sf):
    return table(spark, sf, "events").select("event_id", t.progress_band(F.col("value") / 50, 0.2, 0.8).alias("shown"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, date_trunc('second', ts) AS second FROM events")
def stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second"))


@query("""
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations)
SELECT conv_id, turn, list_sort(list_transform(ws, lambda x: length(x)))[(len(ws) // 2) + 1]::INTEGER AS upper_median FROM w
""")
def upper_median(spark, sf):
    sizes = F.transform(F.split("text", " "), lambda x: F.length(x))
    return table(spark, sf, "conversations").select("conv_id", "turn", t.upper_median(sizes).alias("upper_median"))


@query(f"""
SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all({kana("'們這們說 ' || text")}, '[{X.NON_SIMPLIFIED}]'))) AS chars FROM conversations
""")
def traditional_chars(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.traditional_chars(F.concat(F.lit("們這們說 "), "text")).alias("chars"))


@query(f"SELECT doc_id, {hash24("text")} AS text_hash, {norm("text")} = '' AS blank FROM documents")
def doc_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.text_hash("text").alias("text_hash"), t.is_blank("text").alias("blank"))
