"""Segments, translation memory, quality rules, sequences and terms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliomill.functions import fixed as X
from foliomill.functions import text as t
from foliomill.operators import golden, quality, segments as seg, sequence as sq, terms
from foliomill.sources.tables import HIRAGANA_FROM, HIRAGANA_TO, KATAKANA_FROM, KATAKANA_TO, blocks, pairs, segments, table, translatable, with_matter

from .registry import BLOCK, PAIR, SEGMENT, bare, hash24, kana, kata, norm, query

GLOSSARY = [("いえあ", "sea"), ("thえ", "the"), ("おん", "on")]


# --- segments and memory ---------------------------------------------------------------------------------------------

_MEMORY = SEGMENT + """, memory AS (
  SELECT text_hash, coalesce(source_lang, '') AS source_lang, arg_max('tr ' || text, doc_id * 100000 + ord) AS translation
  FROM segment WHERE doc_id % 2 = 0 GROUP BY ALL
), carried AS (
  SELECT s.*, m.translation FROM segment s JOIN memory m ON s.text_hash = m.text_hash AND s.source_lang = m.source_lang WHERE s.doc_id % 2 = 1
)
"""


def _carried(spark, sf):
    s = segments(spark, sf)
    known = s.filter("doc_id % 2 = 0").withColumn("translation", F.concat(F.lit("tr "), "text"))
    return seg.carry_over(s.filter("doc_id % 2 = 1"), seg.memory_of(known))


@query(SEGMENT + "SELECT seg_id, doc_id, block_id, ord, type, source_lang, text_hash, CAST(length(text) AS INTEGER) AS n FROM segment")
def segment_import(spark, sf):
    return segments(spark, sf).select("seg_id", "doc_id", "block_id", "ord", "type", "source_lang", "text_hash", F.length("text").alias("n"))


@query(BLOCK + "SELECT doc_id, block_id, translatable FROM flagged WHERE translatable")
def translatable_blocks(spark, sf):
    return blocks(spark, sf).withColumn("translatable", translatable()).filter("translatable").select("doc_id", "block_id", "translatable")


_UNIT = BLOCK + """, cells AS (
  SELECT doc_id, ord, block_id, generate_subscripts(rows, 1) - 1 AS r, unnest(rows) AS row FROM block WHERE type = 'table'
), cell AS (
  SELECT doc_id, ord, r, generate_subscripts(row, 1) - 1 AS c, block_id, unnest(row) AS text FROM cells
), unit AS (
  SELECT doc_id, ord, 0 AS r, 0 AS c, block_id AS unit_id, text, type AS kind FROM block WHERE type IN ('heading', 'paragraph')
  UNION ALL SELECT doc_id, ord, r, c, block_id || ':r' || r || 'c' || c, text, 'cell' FROM cell
), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, r, c) AS unit_ord FROM unit)
"""


@query(_UNIT + "SELECT doc_id, unit_id, CAST(unit_ord AS INTEGER) AS unit_ord, kind, text FROM numbered WHERE trim(text) <> ''")
def translation_units(spark, sf):
    return seg.units(blocks(spark, sf))


@query(_MEMORY + "SELECT seg_id, translation FROM carried")
def tm_carry_over(spark, sf):
    return _carried(spark, sf).select("seg_id", "translation")


@query(_MEMORY + "SELECT text_hash, source_lang, count(*) AS hits FROM carried GROUP BY ALL")
def tm_hits(spark, sf):
    return _carried(spark, sf).groupBy("text_hash", "source_lang").agg(F.count(F.lit(1)).alias("hits"))


_OLDNEW = SEGMENT + f""", fresh AS (
  SELECT seg_id, CASE WHEN ord % 7 = 0 THEN text || ' edited' ELSE text || '  ' END AS text FROM segment WHERE ord % 11 <> 0
), new AS (SELECT seg_id, text, {hash24("text")} AS text_hash FROM fresh), old AS (
  SELECT seg_id, text, text_hash, 'done' AS status, 'tr' AS translation FROM segment WHERE ord % 13 <> 0)
"""


def _old_new(spark, sf):
    s = segments(spark, sf)
    text = F.when(F.col("ord") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.concat("text", F.lit("  ")))
    new = s.filter("ord % 11 <> 0").select("seg_id", text.alias("text")).withColumn("text_hash", t.text_hash("text"))
    old = s.filter("ord % 13 <> 0").select("seg_id", "text", "text_hash", F.lit("done").alias("status"), F.lit("tr").alias("translation"), F.lit(None).cast("string").alias("final"))
    return old, new


@query(_OLDNEW + """
SELECT seg_id, CASE WHEN o.text_hash IS NULL THEN 'created' WHEN n.text_hash IS NULL THEN 'orphan' WHEN o.text_hash <> n.text_hash THEN 'updated' ELSE 'unchanged' END AS change
FROM old o FULL JOIN new n USING (seg_id)""")
def reimport_diff(spark, sf):
    return seg.reimport(*_old_new(spark, sf))


@query(_OLDNEW + """
SELECT seg_id, coalesce(n.text, o.text) AS text, CASE WHEN n.text_hash IS NULL THEN o.status WHEN o.text_hash IS NULL OR o.text_hash <> n.text_hash THEN 'pending' ELSE o.status END AS status,
  CASE WHEN n.text_hash IS NULL THEN o.translation WHEN o.text_hash IS NULL OR o.text_hash <> n.text_hash THEN NULL ELSE o.translation END AS translation, n.text_hash IS NULL AS orphan
FROM old o FULL JOIN new n USING (seg_id)""")
def segment_upsert(spark, sf):
    return seg.upsert(*_old_new(spark, sf)).select("seg_id", "text", "status", "translation", "orphan")


@query(_OLDNEW + """
SELECT count(*) FILTER (o.text_hash IS NULL) AS created, count(*) FILTER (n.text_hash IS NULL) AS orphan, count(*) FILTER (o.text_hash <> n.text_hash) AS updated, count(*) FILTER (o.text_hash = n.text_hash) AS unchanged
FROM old o FULL JOIN new n USING (seg_id)""")
def import_stats(spark, sf):
    c = lambda k: F.count_if(F.col("change") == k).alias(k)
    return seg.reimport(*_old_new(spark, sf)).agg(c("created"), c("orphan"), c("updated"), c("unchanged"))


@query(BLOCK + """, s AS (SELECT doc_id, block_id FROM block WHERE type IN ('heading', 'paragraph') AND ord % 9 <> 0)
SELECT doc_id, block_id FROM flagged ANTI JOIN s USING (doc_id, block_id) WHERE translatable""")
def id_mismatch(spark, sf):
    b = blocks(spark, sf).withColumn("translatable", translatable())
    s = b.filter("type in ('heading', 'paragraph') and ord % 9 <> 0")
    return seg.mismatches(b.filter("translatable"), s.select("doc_id", "block_id"))


@query(BLOCK + "SELECT coalesce(type, 'total') AS type, count(*) AS n FROM block GROUP BY ROLLUP (type)")
def block_counts(spark, sf):
    return blocks(spark, sf).rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


@query(BLOCK + "SELECT doc_id, matter, count(*) AS n FROM block GROUP BY ALL")
def matter_counts(spark, sf):
    return with_matter(blocks(spark, sf)).groupBy("doc_id", "matter").agg(F.count(F.lit(1)).alias("n"))


@query(BLOCK + "SELECT doc_id, block_id FROM flagged WHERE translatable AND matter NOT IN ('colophon', 'promo')")
def matter_skip(spark, sf):
    b = with_matter(blocks(spark, sf)).withColumn("translatable", translatable())
    return b.filter(F.col("translatable") & ~F.col("matter").isin(*X.SKIP_MATTER)).select("doc_id", "block_id")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, status")
def status_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


@query(PAIR + """
SELECT count(*) AS n, count(*) FILTER (status = 'done') AS done, CAST(sum(length(source)) AS BIGINT) AS chars, CAST(sum(greatest(1, CAST(floor(length(source) / 1.5) AS INTEGER))) AS BIGINT) AS tokens,
  round(sum(greatest(1, CAST(floor(length(source) / 1.5) AS INTEGER)) / 1e6), 8)::DOUBLE AS cost FROM pair""")
def progress_stats(spark, sf):
    n = t.estimate_tokens("source")
    return pairs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.sum(F.length("source")).alias("chars"), F.sum(n).alias("tokens"), F.round(F.sum(n / 1e6), 8).alias("cost"))


@query(PAIR + "SELECT seg_id, status FROM pair WHERE status = 'pending' AND (source ILIKE '%th%' OR target ILIKE '%th%')")
def segment_search(spark, sf):
    return seg.search(pairs(spark, sf), "TH", "pending", ("source", "target")).select("seg_id", "status")


@query(SEGMENT + "SELECT seg_id, doc_id, ord FROM segment ORDER BY doc_id, ord OFFSET 100 LIMIT 50")
def segment_page(spark, sf):
    return seg.page(segments(spark, sf).select("seg_id", "doc_id", "ord"), ["doc_id", "ord"], 100, 50)


@query(PAIR + "SELECT seg_id, conv_id, turn FROM pair WHERE status IN ('pending', 'failed')")
def pending_segments(spark, sf):
    return pairs(spark, sf).filter(F.col("status").isin("pending", "failed")).select("seg_id", "conv_id", "turn")


@query(SEGMENT + "SELECT text_hash, count(*) AS n, count(DISTINCT doc_id) AS docs, min(seg_id) AS first_seg FROM segment GROUP BY text_hash HAVING count(*) > 1")
def dup_content(spark, sf):
    return seg.duplicates(segments(spark, sf))


# --- quality ---------------------------------------------------------------------------------------------------------

_missing = "CASE " + " ".join(f"WHEN contains(source, '{a}') AND NOT contains(trim(target), '{b}') THEN '{a}'" for a, b in GLOSSARY) + " END"
_ISSUE = PAIR + f""", q AS (
  SELECT seg_id, status, source, trim(target) AS target, {bare("trim(target)")} AS bt, {bare("source")} AS bs, {_missing} AS missing,
    regexp_matches(target, '[{X.HIRAGANA}]') AS hira, regexp_matches(target, '[{X.KATAKANA}]') AS kata,
    len(list_distinct(regexp_extract_all(target, '[{X.NON_SIMPLIFIED}]'))) AS trad FROM pair
), f AS (SELECT *, target = '' AS none, target <> '' AND bt = bs AS same, target <> '' AND bt <> bs AS go FROM q), issue AS (
  SELECT seg_id, 'untranslated' AS kind, CASE WHEN status = 'pending' THEN 'warn' ELSE 'error' END AS severity FROM f WHERE none
  UNION ALL SELECT seg_id, 'source_leak', 'error' FROM f WHERE same AND regexp_matches(bs, '[{X.KANA}]')
  UNION ALL SELECT seg_id, 'kana_left', 'error' FROM f WHERE go AND hira
  UNION ALL SELECT seg_id, 'katakana_left', 'warn' FROM f WHERE go AND NOT hira AND kata
  UNION ALL SELECT seg_id, 'traditional', 'warn' FROM f WHERE go AND trad >= 2
  UNION ALL SELECT seg_id, 'term_missing', 'error' FROM f WHERE go AND missing IS NOT NULL
  UNION ALL SELECT seg_id, 'length_anomaly', 'warn' FROM f WHERE go AND length(bs) >= 6 AND (length(bt) / length(bs) < 0.12 OR length(bt) / length(bs) > 3.0)
)
"""


@query(_ISSUE + "SELECT seg_id, kind, severity FROM issue")
def qa_issues(spark, sf):
    return quality.issues(pairs(spark, sf), GLOSSARY)


@query(_ISSUE + "SELECT kind, severity, count(*) AS n FROM issue GROUP BY ALL")
def qa_counts(spark, sf):
    return quality.counts(quality.issues(pairs(spark, sf), GLOSSARY))


@query(_ISSUE + "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM issue")
def qa_gate(spark, sf):
    return quality.passed(quality.issues(pairs(spark, sf), GLOSSARY))


@query(_ISSUE + "SELECT seg_id, kind, severity, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seg_id) AS rn FROM issue) WHERE rn <= 5")
def qa_top_examples(spark, sf):
    return quality.examples(quality.issues(pairs(spark, sf), GLOSSARY), 5)


@query(PAIR + "SELECT seg_id, arg_min(term, gl_order) AS term FROM pair JOIN (VALUES " + ", ".join(f"({n}, '{a}', '{b}')" for n, (a, b) in enumerate(GLOSSARY, 1)) + ") g(gl_order, term, expected) ON contains(source, term) AND NOT contains(target, expected) WHERE target <> '' GROUP BY seg_id")
def qa_term_missing(spark, sf):
    g = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(GLOSSARY, 1)], "gl_order int, term string, expected string")
    return quality.missing_terms(pairs(spark, sf), g)


_JUDGE = PAIR + f""", q AS (
  SELECT 'a' AS engine, seg_id, source, target FROM pair UNION ALL SELECT 'b', seg_id, source, {kata("target")} FROM pair
), j AS (SELECT *, trim(target) = '' AS none, {bare("source")} AS bs, {bare("target")} AS bt, length({norm("source")}) AS n, length({norm("target")}) AS m,
    {_missing.replace("trim(target)", "target")} AS missing, regexp_matches(target, '[{X.HIRAGANA}]') AS hira, regexp_matches(target, '[{X.KATAKANA}]') AS kata,
    len(list_distinct(regexp_extract_all(target, '[{X.NON_SIMPLIFIED}]'))) AS trad FROM q), verdict AS (
  SELECT engine, seg_id, 'empty' AS kind FROM j WHERE none
  UNION ALL SELECT engine, seg_id, 'untranslated' FROM j WHERE NOT none AND bs = bt AND bs <> '' AND regexp_matches(bs, '[{X.KANA}]')
  UNION ALL SELECT engine, seg_id, 'kana_left' FROM j WHERE NOT none AND hira
  UNION ALL SELECT engine, seg_id, 'katakana_left' FROM j WHERE NOT none AND NOT hira AND kata
  UNION ALL SELECT engine, seg_id, 'length_anomaly' FROM j WHERE NOT none AND n >= 6 AND (m / n < 0.12 OR m / n > 3.0)
  UNION ALL SELECT engine, seg_id, 'term_missing' FROM j WHERE NOT none AND missing IS NOT NULL
  UNION ALL SELECT engine, seg_id, 'traditional' FROM j WHERE NOT none AND trad >= 2)
"""


def _engines(spark, sf):
    p = pairs(spark, sf).select("seg_id", "source", "target")
    return p.select(F.lit("a").alias("engine"), "*").unionByName(p.select(F.lit("b").alias("engine"), "seg_id", "source", F.translate("target", KATAKANA_FROM, KATAKANA_TO).alias("target")))


def _judged(spark, sf):
    e = _engines(spark, sf).withColumn("both", F.struct("engine", "seg_id"))
    return quality.judge(e.drop("seg_id").withColumnRenamed("both", "seg_id"), GLOSSARY).select("seg_id.engine", "seg_id.seg_id", "kind")


@query(_JUDGE + "SELECT engine, seg_id, kind FROM verdict")
def engine_judge(spark, sf):
    return _judged(spark, sf)


@query(_JUDGE + """, a AS (SELECT engine, count(*) AS segments, CAST(sum(length(target)) AS BIGINT) AS out_chars FROM q GROUP BY engine), b AS (SELECT engine, count(*) AS issues FROM verdict GROUP BY engine)
SELECT engine, segments, out_chars, coalesce(issues, 0) AS issues, round(coalesce(issues, 0) * 1000.0 / out_chars, 6)::DOUBLE AS per_thousand FROM a LEFT JOIN b USING (engine)""")
def engine_report(spark, sf):
    return quality.engine_report(_engines(spark, sf), _judged(spark, sf))


@query(_JUDGE + "SELECT seg_id, max(target) FILTER (engine = 'a') AS a, max(target) FILTER (engine = 'b') AS b FROM q GROUP BY seg_id")
def engine_compare_pivot(spark, sf):
    return quality.side_by_side(_engines(spark, sf), ["a", "b"])


@query(_MEMORY + "SELECT seg_id, translation FROM carried WHERE translation <> 'tr ' || text")
def mistranslation_audit(spark, sf):
    return _carried(spark, sf).filter(F.col("translation") != F.concat(F.lit("tr "), "text")).select("seg_id", "translation")


# --- sequences -------------------------------------------------------------------------------------------------------

_CHAPTER = BLOCK + """, t AS (SELECT *, coalesce(min(CASE WHEN type = 'heading' THEN coalesce(level, 1) END) OVER (PARTITION BY doc_id), 1) AS top FROM flagged),
h AS (SELECT *, type = 'heading' AND coalesce(level, 1) <= top AND trim(text) <> '' AS is_top, matter IN ('main', 'afterword') AS story FROM t),
c AS (SELECT *, sum(CASE WHEN is_top AND story THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS chapter FROM h),
k AS (SELECT * FROM c WHERE (is_top AND story) OR (NOT is_top AND translatable AND story)),
chaptered AS (SELECT doc_id, ord, block_id, text, CAST(chapter AS BIGINT) AS chapter,
  CASE WHEN chapter = 0 THEN '（前言）' ELSE max(CASE WHEN is_top THEN trim(text) END) OVER (PARTITION BY doc_id, chapter) END AS title FROM k),
chapter_text AS (SELECT doc_id, chapter, title, count(*) AS blocks, coalesce(substr(string_agg(text, chr(10) ORDER BY ord) FILTER (trim(text) <> ''), 1, 6000), '') AS text FROM chaptered GROUP BY ALL)
"""


def _chapters(spark, sf):
    return sq.chapters(with_matter(blocks(spark, sf)).withColumn("translatable", translatable()))


@query(_CHAPTER + "SELECT doc_id, block_id, chapter FROM chaptered")
def chapter_of_block(spark, sf):
    return _chapters(spark, sf).select("doc_id", "block_id", "chapter")


@query(_CHAPTER + "SELECT doc_id, chapter, title, blocks FROM chapter_text")
def chapters(spark, sf):
    return sq.chapter_texts(_chapters(spark, sf), 6000).select("doc_id", "chapter", "title", "blocks")


@query(_CHAPTER + "SELECT doc_id, chapter, text FROM chapter_text")
def chapter_text(spark, sf):
    return sq.chapter_texts(_chapters(spark, sf), 6000).select("doc_id", "chapter", "text")


_BATCH = SEGMENT.replace("WITH lines", "WITH RECURSIVE lines", 1) + """, item AS (
  SELECT doc_id, ord, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM segment
), fold AS (
  SELECT doc_id, ord, k, n AS used, 1 AS cnt, 0 AS batch FROM item WHERE k = 1
  UNION ALL
  SELECT i.doc_id, i.ord, i.k, CASE WHEN f.used + i.n > 2400 OR f.cnt >= 24 THEN i.n ELSE f.used + i.n END,
    CASE WHEN f.used + i.n > 2400 OR f.cnt >= 24 THEN 1 ELSE f.cnt + 1 END, f.batch + CASE WHEN f.used + i.n > 2400 OR f.cnt >= 24 THEN 1 ELSE 0 END
  FROM fold f JOIN item i ON i.doc_id = f.doc_id AND i.k = f.k + 1
)
"""


def _batches(spark, sf):
    return sq.batches(segments(spark, sf).select("doc_id", "ord", F.length("text").alias("n")))


@query(_BATCH + "SELECT doc_id, ord, batch FROM fold")
def batches(spark, sf):
    return _batches(spark, sf)


@query(_BATCH + """, cost AS (SELECT f.doc_id, f.batch, sum(greatest(1, CAST(floor(i.n / 1.5) AS INTEGER))) / 1000.0 AS cost FROM fold f JOIN item i USING (doc_id, ord) GROUP BY ALL),
b AS (SELECT doc_id, batch, coalesce(sum(cost) OVER (PARTITION BY doc_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM cost)
SELECT doc_id, batch, round(spent, 10)::DOUBLE AS spent_before FROM b WHERE spent < 2.0""")
def cost_guard(spark, sf):
    s = segments(spark, sf).select("doc_id", "ord", t.estimate_tokens("text").alias("tokens"))
    cost = _batches(spark, sf).join(s, ["doc_id", "ord"]).groupBy("doc_id", "batch").agg((F.sum("tokens") / 1000.0).alias("cost"))
    return sq.cost_guard(cost, 2.0).select("doc_id", "batch", "spent_before")


@query(_BATCH + """SELECT f.doc_id, f.batch, f.ord, CAST(sum(greatest(1, CAST(floor(i.n / 1.5) AS INTEGER))) OVER (PARTITION BY f.doc_id, f.batch) // count(*) OVER (PARTITION BY f.doc_id, f.batch) AS BIGINT) AS share
FROM fold f JOIN item i USING (doc_id, ord)""")
def batch_attribution(spark, sf):
    s = segments(spark, sf).select("doc_id", "ord", t.estimate_tokens("text").alias("tokens"))
    w = W.partitionBy("doc_id", "batch")
    return _batches(spark, sf).join(s, ["doc_id", "ord"]).select("doc_id", "batch", "ord", F.floor(F.sum("tokens").over(w) / F.count(F.lit(1)).over(w)).alias("share"))


@query(SEGMENT + "SELECT doc_id, CAST(sum(greatest(1, CAST(floor(length(text) / 1.5) AS INTEGER))) AS BIGINT) AS tokens_in, round(sum(greatest(1, CAST(floor(length(text) / 1.5) AS INTEGER))) * 1.4 * 0.7, 4)::DOUBLE AS tokens_out FROM segment GROUP BY doc_id")
def dry_run_cost(spark, sf):
    n = F.sum(t.estimate_tokens("text"))
    return segments(spark, sf).groupBy("doc_id").agg(n.alias("tokens_in"), F.round(n * 1.4 * 0.7, 4).alias("tokens_out"))


@query(_CHAPTER + ", s AS (SELECT doc_id, chapter, substr(text, 1, 20) AS summary FROM chapter_text) SELECT doc_id, chapter, coalesce(string_agg(summary, chr(10)) OVER (PARTITION BY doc_id ORDER BY chapter ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM s")
def prev_context(spark, sf):
    s = sq.chapter_texts(_chapters(spark, sf), 6000).select("doc_id", "chapter", F.substring("text", 1, 20).alias("summary"))
    return sq.previous_context(s)


@query(_CHAPTER + """, s AS (SELECT doc_id, chapter, substr(text, 1, 20) AS summary FROM chapter_text WHERE chapter % 2 = 0), r AS (SELECT DISTINCT doc_id, chapter FROM chapter_text WHERE chapter % 2 = 1),
j AS (SELECT r.doc_id, r.chapter, s.chapter AS sc, s.summary, row_number() OVER (PARTITION BY r.doc_id, r.chapter ORDER BY s.chapter DESC) AS rn FROM r JOIN s ON r.doc_id = s.doc_id AND s.chapter < r.chapter)
SELECT doc_id, chapter, string_agg(summary, chr(10) ORDER BY sc) AS context FROM j WHERE rn <= 4 GROUP BY ALL""")
def context_range_join(spark, sf):
    s = sq.chapter_texts(_chapters(spark, sf), 6000).select("doc_id", "chapter", F.substring("text", 1, 20).alias("summary"))
    return sq.context_for(s.filter("chapter % 2 = 1").select("doc_id", "chapter"), s.filter("chapter % 2 = 0"))


@query(_CHAPTER + "SELECT doc_id, chapter, text FROM chapter_text SEMI JOIN (SELECT doc_id, chapter FROM chapter_text WHERE blocks > 3) USING (doc_id, chapter)")
def prune_summaries(spark, sf):
    s = sq.chapter_texts(_chapters(spark, sf), 6000)
    return sq.prune(s, s.filter("blocks > 3").select("doc_id", "chapter")).select("doc_id", "chapter", "text")


@query(BLOCK + """, i AS (SELECT doc_id, ord, matter, 'images/' || CASE WHEN ord % 34 = 0 THEN 'cover' ELSE 'p' END || ord || '.jpg' AS path FROM block WHERE type = 'image'),
r AS (SELECT *, CASE WHEN matter = 'cover' THEN 0 WHEN regexp_matches(path, '(?i)cover|hyoshi|表紙') THEN 1 END AS rank FROM i)
SELECT doc_id, arg_min(path, rank * 1000000 + ord) AS path FROM r WHERE rank IS NOT NULL GROUP BY doc_id""")
def cover_pick(spark, sf):
    path = F.concat(F.lit("images/"), F.when(F.col("ord") % 34 == 0, "cover").otherwise("p"), F.col("ord").cast("string"), F.lit(".jpg"))
    return sq.pick_cover(with_matter(blocks(spark, sf)).filter("type = 'image'").withColumn("path", path))


# --- terms and golden comparison -------------------------------------------------------------------------------------

_TERM_TEXT = f"{kata('text')} || ' 『' || substr(text, 1, 8) || '』 氷上決戦' || CASE WHEN turn % 2 = 0 THEN 'コーヒー' ELSE '' END"
_stop = ", ".join(f"'{x}'" for x in X.STOP_KATAKANA)
_stopj = ", ".join(f"'{x}'" for x in X.STOP_KANJI)
_TERM = f"""
WITH x AS (SELECT conv_id AS doc_id, turn AS ord, {_TERM_TEXT} AS text FROM conversations),
p AS (SELECT doc_id, ord, text, 0 AS rank, 'katakana' AS kind, regexp_extract_all(text, '{X.TERM_KATAKANA}') AS ms FROM x
      UNION ALL SELECT doc_id, ord, text, 1, 'quoted', regexp_extract_all(text, '{X.TERM_QUOTED}', 1) FROM x
      UNION ALL SELECT doc_id, ord, text, 2, 'kanji', regexp_extract_all(text, '{X.TERM_KANJI}') FROM x),
m AS (SELECT doc_id, ord, text, rank, kind, generate_subscripts(ms, 1) AS pos, unnest(ms) AS term FROM p),
k AS (SELECT * FROM m WHERE NOT (kind = 'katakana' AND term IN ({_stop})) AND NOT (kind = 'kanji' AND term IN ({_stopj})) AND NOT regexp_matches(term, '^[ぁ-ゟー]+$')),
cand AS (SELECT term, count(*) AS n, arg_min(kind, (doc_id, ord, rank, pos)) AS kind, arg_min(substr(text, 1, 48), (doc_id, ord, rank, pos)) AS sample FROM k
         GROUP BY term HAVING count(*) >= 3 AND NOT regexp_matches(term, '^\\d+$'))
"""


def _term_texts(spark, sf):
    base = F.concat(F.translate("text", KATAKANA_FROM, KATAKANA_TO), F.lit(" 『"), F.substring("text", 1, 8), F.lit("』 氷上決戦"), F.when(F.col("turn") % 2 == 0, "コーヒー").otherwise(""))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), base.alias("text"))


@query(_TERM + "SELECT term, n, kind, sample FROM cand ORDER BY n DESC, term LIMIT 400")
def term_candidates(spark, sf):
    return terms.top_terms(_term_texts(spark, sf))


@query(_TERM + "SELECT kind, count(*) AS terms, CAST(sum(n) AS BIGINT) AS mentions FROM cand GROUP BY kind")
def term_kinds(spark, sf):
    return terms.candidates(_term_texts(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("mentions"))


_GOLD = SEGMENT + ", a AS (SELECT * FROM segment WHERE doc_id % 3 <> 0), b AS (SELECT * FROM segment WHERE doc_id % 3 <> 1)"


def _sides(spark, sf):
    s = segments(spark, sf)
    return s.filter("doc_id % 3 <> 0"), s.filter("doc_id % 3 <> 1")


@query(_GOLD + """, x AS (SELECT DISTINCT text FROM a), y AS (SELECT DISTINCT text FROM b), n AS (SELECT (SELECT count(*) FROM x) AS left_n, (SELECT count(*) FROM y) AS right_n, (SELECT count(*) FROM x SEMI JOIN y USING (text)) AS common)
SELECT left_n, right_n, common, left_n - common AS left_only, right_n - common AS right_only, round(common / left_n, 6) AS precision, round(common / right_n, 6) AS coverage FROM n""")
def golden_overlap(spark, sf):
    return golden.overlap(*_sides(spark, sf))


@query(_GOLD + "SELECT DISTINCT text FROM a EXCEPT SELECT text FROM b")
def golden_only_left(spark, sf):
    a, b = _sides(spark, sf)
    return a.select("text").subtract(b.select("text"))


@query(_GOLD + "SELECT DISTINCT text FROM a INTERSECT SELECT text FROM b")
def golden_common(spark, sf):
    a, b = _sides(spark, sf)
    return a.select("text").intersect(b.select("text"))


@query(SEGMENT + "SELECT DISTINCT h.seg_id FROM segment h JOIN segment l ON h.doc_id = l.doc_id AND contains(l.text, h.text) AND length(l.text) > length(h.text)")
def golden_fragments(spark, sf):
    s = segments(spark, sf)
    return golden.fragments(s, s, ["doc_id"]).select("seg_id")


@query(SEGMENT + """, j AS (
  SELECT x.seg_id AS a_id, y.seg_id AS b_id, x.text AS s, y.text AS t FROM segment x JOIN segment y ON x.doc_id = y.doc_id AND x.seg_id <> y.seg_id AND abs(length(x.text) - length(y.text)) <= 40),
c AS (SELECT a_id, b_id, s, t, list_filter(string_split(s, ''), lambda c: c <> '') AS xs, list_filter(string_split(t, ''), lambda c: c <> '') AS ys FROM j),
k AS (SELECT a_id, b_id, round(2.0::DOUBLE * list_sum(list_transform(list_distinct(xs), lambda c: least(len(list_filter(xs, lambda u: u = c)), len(list_filter(ys, lambda u: u = c))))) / (length(s) + length(t)), 6)::DOUBLE AS score FROM c)
SELECT a_id, b_id, score FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rn FROM k) WHERE rn = 1""")
def golden_residual(spark, sf):
    s = segments(spark, sf).select("doc_id", F.col("seg_id").alias("id"), "text")
    return golden.nearest(s, s, "doc_id").select("a_id", "b_id", "score")


@query(PAIR + f"SELECT seg_id, CAST(length(regexp_replace(source, '[^ぁ-ゟァ-ヶ]', '', 'g')) AS INTEGER) AS kana, CAST(length(regexp_replace(source, '[^一-鿿]', '', 'g')) AS INTEGER) AS kanji, CAST(length(regexp_replace(source, '[^\\x21-\\x7e]', '', 'g')) AS INTEGER) AS ascii, CAST(length(source) AS INTEGER) AS chars FROM pair")
def char_profile(spark, sf):
    return pairs(spark, sf).select("seg_id", golden.char_profile(F.col("source")).alias("p")).select("seg_id", "p.*")


@query(f"SELECT count(*) AS n, CAST(sum(len(regexp_extract_all({kana('text')}, '[ぁ-ゟ] [ぁ-ゟ]'))) AS BIGINT) AS spaced FROM conversations")
def cjk_space_residual(spark, sf):
    k = F.translate("text", HIRAGANA_FROM, HIRAGANA_TO)
    return table(spark, sf, "conversations").agg(F.count(F.lit(1)).alias("n"), F.sum(F.regexp_count(k, F.lit("[ぁ-ゟ] [ぁ-ゟ]"))).alias("spaced"))


_SQUEEZED, _PLAIN = ((f"regexp_replace({x}, '\\s+', '', 'g')" for x in ("source", "target")), [f"regexp_replace(regexp_replace({x}, '\\s+', '', 'g'), '[[:punct:]]', '', 'g')" for x in ("source", "target")])


@query(PAIR + f"SELECT CASE WHEN source = target THEN 'equal' WHEN {' = '.join(_SQUEEZED)} THEN 'space' WHEN {' = '.join(_PLAIN)} THEN 'punctuation' WHEN {' = '.join(f'lower({x})' for x in _PLAIN)} THEN 'case' ELSE 'text' END AS class, count(*) AS n FROM (SELECT source, CASE turn % 5 WHEN 0 THEN source || ' !' WHEN 1 THEN translate(source, 'bcdfst', 'BCDFST') WHEN 2 THEN replace(source, ' ', '  ') WHEN 3 THEN source ELSE target END AS target FROM pair) GROUP BY 1")
def residual_classes(spark, sf):
    n, s = F.col("turn") % 5, F.col("source")
    target = F.when(n == 0, F.concat(s, F.lit(" !"))).when(n == 1, F.translate(s, "bcdfst", "BCDFST")).when(n == 2, F.replace(s, F.lit(" "), F.lit("  "))).when(n == 3, s).otherwise(F.col("target"))
    return pairs(spark, sf).groupBy(golden.residual_class(s, target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query()
def similarity(spark, sf):
    return pairs(spark, sf).select("seg_id", golden.sequence_ratio("source", "target").alias("ratio"))


@query(_MEMORY + """, i AS (SELECT c.doc_id, count(*) AS hits FROM carried c GROUP BY c.doc_id), n AS (SELECT doc_id, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars FROM segment GROUP BY doc_id)
SELECT n.doc_id, n.segments, n.chars, coalesce(i.hits, 0) AS hits, n.segments - coalesce(i.hits, 0) AS pending FROM n LEFT JOIN i ON n.doc_id = i.doc_id""")
def flagship_segment_qa(spark, sf):
    """Documents to blocks, segments, hashes, memory hits and what is left to do, for each document."""
    n = segments(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"))
    hits = _carried(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    h = F.coalesce("hits", F.lit(0))
    return n.join(hits, "doc_id", "left").select("doc_id", "segments", "chars", h.alias("hits"), (F.col("segments") - h).alias("pending"))
