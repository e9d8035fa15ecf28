"""The shelf: statistics and views of books, upserts, package rules, small reports and receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators import golden, library as lib, packages as pk, quality, segments as seg, sequence as sq, terms
from foliomill.sources.tables import blocks, job_events, page_rows, pairs, segments, table, translatable, with_matter

from .registry import BLOCK, JOB, PAGE_ROW, PAIR, SEGMENT, query
from .segment_queries import _BATCH, _CHAPTER, _GOLD, _ISSUE, _MEMORY, _TERM, _UNIT, GLOSSARY, _carried, _chapters, _sides, _term_texts

# --- projections and filters -----------------------------------------------------------------------------------------

_DONE = PAIR + """, seg AS (SELECT seg_id, conv_id AS doc_id, turn, source, CASE WHEN turn % 3 <> 0 THEN target END AS translation, CASE WHEN turn % 6 = 0 THEN source END AS final,
  CASE WHEN turn % 3 <> 0 THEN length(source) // 2 END AS tokens_in, CASE WHEN turn % 3 <> 0 THEN length(target) // 2 END AS tokens_out FROM pair)
"""


def _done(spark, sf):
    p = pairs(spark, sf)
    when = lambda x: F.when(F.col("turn") % 3 != 0, x)
    half = lambda c: when(F.floor(F.length(c) / 2).cast("long"))
    return p.select(
        "seg_id", F.col("conv_id").alias("doc_id"), "turn", "source", when(F.col("target")).alias("translation"), F.when(F.col("turn") % 6 == 0, F.col("source")).alias("final"),
        half("source").alias("tokens_in"), half("target").alias("tokens_out"),
    ).withColumn("cost", F.col("tokens_in") / 1000.0)


@query(_DONE + "SELECT seg_id, coalesce(final, translation) AS text FROM seg WHERE coalesce(final, translation) IS NOT NULL")
def only_translated(spark, sf):
    return lib.only_translated(_done(spark, sf)).select("seg_id", F.coalesce("final", "translation").alias("text"))


@query(JOB + "SELECT job_id, seq, CASE WHEN status = 'click' AND progress >= 0.5 THEN 'done' ELSE status END AS status, CASE WHEN status = 'click' AND progress >= 0.5 THEN 1.0 ELSE progress END::DOUBLE AS progress FROM job")
def job_update(spark, sf):
    e = job_events(spark, sf)
    out = lib.update_columns(e, (F.col("status") == "click") & (F.col("progress") >= 0.5), {"status": F.lit("done"), "progress": F.lit(1.0)}, ("status", "progress", "message"))
    return out.select("job_id", "seq", "status", "progress")


@query(JOB + "SELECT job_id, status, progress FROM job")
def job_view(spark, sf):
    return lib.job_view(job_events(spark, sf).withColumn("params", F.lit("{}")))


_FILE = """WITH f AS (SELECT CAST(page_id % 50 AS VARCHAR) AS project, CASE page_id % 4 WHEN 0 THEN 'book' || page_id || '.EPUB' WHEN 1 THEN 'source.' || CASE WHEN page_id % 8 = 1 THEN 'pdf' ELSE 'epub' END
  WHEN 2 THEN 'out' || page_id || '.pdf' ELSE 'note' || page_id || '.txt' END AS name, strlen(html) AS bytes FROM pages)
"""


def _files(spark, sf):
    n = F.col("page_id")
    name = F.when(n % 4 == 0, F.concat(F.lit("book"), n, F.lit(".EPUB"))).when(n % 4 == 1, F.when(n % 8 == 1, "source.pdf").otherwise("source.epub")).when(n % 4 == 2, F.concat(F.lit("out"), n, F.lit(".pdf"))).otherwise(F.concat(F.lit("note"), n, F.lit(".txt")))
    return table(spark, sf, "pages").select((n % 50).cast("string").alias("project"), name.alias("name"), F.octet_length("html").alias("bytes"))


@query(_FILE + "SELECT project, coalesce(string_agg(name, ' ' ORDER BY name) FILTER (regexp_matches(lower(name), '\\.(epub|pdf)$') AND NOT starts_with(name, 'source.')), '') AS outputs FROM f GROUP BY project")
def product_list(spark, sf):
    return lib.products(_files(spark, sf)).select("project", F.array_join("outputs", " ").alias("outputs"))


@query(_FILE + "SELECT project, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM f WHERE CAST(project AS INTEGER) % 7 = 0 GROUP BY project")
def delete_receipts(spark, sf):
    f = _files(spark, sf)
    return lib.delete_receipts(f, f.filter(F.col("project").cast("int") % 7 == 0))


@query(_CHAPTER + """, u AS (SELECT s.doc_id, s.block_id, s.ord, s.text, dense_rank() OVER (PARTITION BY s.doc_id ORDER BY s.ord) AS n FROM block s SEMI JOIN (SELECT * FROM chaptered WHERE chapter = 1) c ON s.doc_id = c.doc_id AND s.block_id = c.block_id
  WHERE s.type IN ('heading', 'paragraph') AND trim(s.text) <> '') SELECT doc_id, block_id, text FROM u WHERE n <= 5""")
def chapter_sample(spark, sf):
    return lib.chapter_sample(segments(spark, sf), _chapters(spark, sf).filter("chapter = 1"), 5).select("doc_id", "block_id", "text")


@query(_ISSUE + "SELECT seg_id, kind, severity FROM issue ORDER BY seg_id, kind LIMIT 500")
def qa_page(spark, sf):
    return lib.first_issues(quality.issues(pairs(spark, sf), GLOSSARY))


@query("SELECT CAST(gl_order AS INTEGER) AS gl_order, term || ' = ' || expected AS line FROM (SELECT p_partkey AS gl_order, p_name AS term, p_brand AS expected FROM part) ORDER BY gl_order LIMIT 200")
def glossary_block(spark, sf):
    return lib.glossary_block(table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("gl_order"), F.col("p_name").alias("term"), F.col("p_brand").alias("expected")))


@query(_GOLD + "SELECT text FROM (SELECT DISTINCT text FROM a) ANTI JOIN b USING (text) ORDER BY length(text) DESC, text LIMIT 5")
def longest_only_left(spark, sf):
    return lib.longest_only_in(*_sides(spark, sf))


@query(SEGMENT + "SELECT count(*) AS total FROM segment")
def segment_total(spark, sf):
    return segments(spark, sf).agg(F.count(F.lit(1)).alias("total"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), p AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM w),
f AS (SELECT conv_id, turn, w, min(k) AS k FROM p GROUP BY ALL) SELECT conv_id, turn, string_agg(w, ' ' ORDER BY k) AS words FROM f GROUP BY ALL""")
def distinct_in_order(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(lib.distinct_in_order(F.split("text", " ")), " ").alias("words"))


# --- statistics ------------------------------------------------------------------------------------------------------


@query(_DONE + """SELECT count(*) AS n, count(translation) AS done, count(final) AS reviewed, round(sum(tokens_in / 1000.0), 6)::DOUBLE AS cost, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
  (SELECT count(DISTINCT source) FROM seg WHERE translation <> '') AS memory_entries FROM seg""")
def shelf_stats(spark, sf):
    s = _done(spark, sf)
    return lib.progress(s, s.filter("translation <> ''").select("source").distinct()).withColumn("cost", F.round("cost", 6))


@query(_DONE + """, d AS (SELECT DISTINCT doc_id FROM seg), s AS (SELECT doc_id, count(*) AS chapters, sum(tokens_in / 1000.0) AS cost, sum(tokens_in) AS ti, sum(tokens_out) AS tn FROM seg WHERE translation IS NOT NULL AND doc_id % 3 <> 0 GROUP BY doc_id)
SELECT doc_id, coalesce(chapters, 0) AS chapters, round(coalesce(cost, 0), 6)::DOUBLE AS cost, CAST(coalesce(ti, 0) AS BIGINT) AS tokens_in, CAST(coalesce(tn, 0) AS BIGINT) AS tokens_out FROM d LEFT JOIN s USING (doc_id)""")
def summary_stats(spark, sf):
    s = _done(spark, sf)
    out = lib.summary_stats(s.select("doc_id").distinct(), s.filter("translation is not null and doc_id % 3 <> 0"))
    return out.withColumn("cost", F.round("cost", 6))


@query("""WITH c AS (SELECT conv_id, string_split(translate(text, 'aeiou', 'あえいおう'), '') AS cs FROM conversations), p AS (SELECT conv_id AS doc_id, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS ch FROM c),
q AS (SELECT doc_id, regexp_matches(ch, '[ぁ-ゟァ-ヿ]') AND pos % 5 = 0 AS small FROM p) SELECT doc_id, count(*) FILTER (small) AS small, count(*) AS chars, round(count(*) FILTER (small) / count(*), 6)::DOUBLE AS share FROM q GROUP BY doc_id""")
def small_kana_share(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.posexplode(F.filter(F.split(F.translate("text", "aeiou", "あえいおう"), ""), lambda x: x != "")).alias("pos", "ch"))
    high = F.when(F.col("pos") % 5 == 0, 6.0).otherwise(12.0)
    return lib.small_kana_share(c.select("doc_id", "ch", F.lit(0.0).alias("y0"), high.alias("y1"), F.lit(12.0).alias("h")))


@query(BLOCK + """SELECT doc_id, min(lang) AS source_lang, count(*) AS blocks, count(*) FILTER (type = 'heading') AS headings, count(*) FILTER (type = 'paragraph') AS paragraphs, count(*) FILTER (type = 'image') AS images, count(*) FILTER (type = 'table') AS tables,
  count(*) FILTER (matter = 'main') AS main, count(*) FILTER (translatable) AS translatable, count(*) FILTER (type = 'heading' AND level = 1) AS toc FROM flagged GROUP BY doc_id""")
def book_view(spark, sf):
    return lib.book_view(with_matter(blocks(spark, sf)).withColumn("translatable", translatable()).withColumn("source_lang", F.col("lang")))


@query(PAGE_ROW + "SELECT doc_id, count(DISTINCT page) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (row IN (0, 99)) AS headers_dropped FROM page_row GROUP BY doc_id")
def page_stats(spark, sf):
    r = page_rows(spark, sf)
    return lib.page_stats(r, r.filter("row not in (0, 99)"))


@query(BLOCK + "SELECT doc_id, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'footnote') AS footnotes FROM block GROUP BY doc_id")
def block_extras(spark, sf):
    return lib.extras(blocks(spark, sf))


_ENTRY = BLOCK + """, entry AS (SELECT doc_id, ord AS entry_no, CASE WHEN type = 'image' THEN 'i/' || ord || '.JPG' WHEN ord = 1 AND doc_id % 3 <> 0 THEN 'mimetype' WHEN ord = 2 AND doc_id % 4 <> 0 THEN 'META-INF/container.xml'
  WHEN ord = 3 THEN 'content.opf' ELSE 't/' || ord || '.xhtml' END AS name, doc_id % 5 = 0 AS compressed, CASE WHEN doc_id % 7 = 0 THEN 'text/plain' ELSE 'application/epub+zip' END AS head FROM block),
doc AS (SELECT DISTINCT doc_id FROM entry)
"""


def _entries(spark, sf):
    n, d = F.col("ord"), F.col("doc_id")
    name = (
        F.when(F.col("type") == "image", F.format_string("i/%d.JPG", n)).when((n == 1) & (d % 3 != 0), "mimetype").when((n == 2) & (d % 4 != 0), "META-INF/container.xml")
        .when(n == 3, "content.opf").otherwise(F.format_string("t/%d.xhtml", n))
    )
    return blocks(spark, sf).select("doc_id", n.alias("entry_no"), name.alias("name"), (d % 5 == 0).alias("compressed"), F.when(d % 7 == 0, "text/plain").otherwise("application/epub+zip").alias("head"))


@query(_ENTRY + "SELECT doc_id, count(*) FILTER (name LIKE 'i/%') AS images, count(*) FILTER (name LIKE '%.xhtml') AS xhtml FROM entry GROUP BY doc_id")
def entry_counts(spark, sf):
    return lib.entry_counts(_entries(spark, sf))


@query(_ENTRY + """, d AS (SELECT DISTINCT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000000 ELSE 0 END AS doc_id FROM doc)
SELECT d.doc_id, 'error' AS level, 'missing' AS code, CAST(NULL AS VARCHAR) AS "where" FROM d ANTI JOIN doc USING (doc_id)
UNION ALL SELECT doc_id, 'error', 'mimetype-order', arg_min(name, entry_no) FROM entry GROUP BY doc_id HAVING arg_min(name, entry_no) <> 'mimetype'
UNION ALL SELECT doc_id, 'error', 'mimetype-compressed', name FROM entry WHERE name = 'mimetype' AND compressed
UNION ALL SELECT doc_id, 'error', 'mimetype-content', head FROM entry WHERE name = 'mimetype' AND head <> 'application/epub+zip'
UNION ALL SELECT doc_id, 'error', 'no-container', NULL FROM doc ANTI JOIN (SELECT doc_id FROM entry WHERE name = 'META-INF/container.xml') c USING (doc_id)
UNION ALL SELECT r.doc_id, 'error', 'bad-rootfile', 'content.opf' FROM (SELECT doc_id FROM doc) r ANTI JOIN (SELECT doc_id FROM entry WHERE name = 'content.opf') e USING (doc_id)""")
def package_rules(spark, sf):
    e = _entries(spark, sf)
    docs = e.select("doc_id").distinct()
    wanted = docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1000000000).otherwise(0)).alias("doc_id"))
    parts = [pk.missing_files(wanted, e), pk.mimetype(e), pk.containers(e, docs, docs.withColumn("path", F.lit("content.opf")))]
    return reduce(DataFrame.unionByName, parts)


@query(BLOCK + """, d AS (SELECT DISTINCT doc_id FROM block), m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'b000001' END AS cover_id FROM d WHERE doc_id % 2 = 0)
SELECT doc_id, 'warn' AS level, 'no-cover-meta' AS code, CAST(NULL AS VARCHAR) AS "where" FROM d ANTI JOIN m USING (doc_id)
UNION ALL SELECT m.doc_id, 'error', 'bad-cover-meta', m.cover_id FROM m ANTI JOIN block b ON m.doc_id = b.doc_id AND m.cover_id = b.block_id""")
def cover_rules(spark, sf):
    b = blocks(spark, sf).select("doc_id", F.col("block_id").alias("item_id"))
    docs = b.select("doc_id").distinct()
    metas = docs.filter("doc_id % 2 = 0").withColumn("cover_id", F.when(F.col("doc_id") % 3 == 0, "none").otherwise("b000001"))
    return pk.covers(metas, b, docs)


@query("""SELECT page_id AS doc_id, 'error' AS level, CASE page_id % 3 WHEN 0 THEN 'malformed' ELSE 'not-html' END AS code, 't/' || page_id || '.xhtml' AS "where" FROM pages WHERE page_id % 3 <> 2""")
def xhtml_rules(spark, sf):
    n = F.col("page_id")
    body = F.concat(F.lit("<p>"), F.regexp_replace("url", "[&<>]", " "), F.lit("</p>"))
    content = F.when(n % 3 == 0, F.concat(F.lit("<html>"), body)).when(n % 3 == 1, F.concat(F.lit("<body>"), body, F.lit("</body>"))).otherwise(F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml">'), body, F.lit("</html>")))
    return pk.malformed(table(spark, sf, "pages").select(n.alias("doc_id"), F.format_string("t/%d.xhtml", n).alias("name"), content.alias("content")))


@query("""SELECT event_id AS doc_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS level, 'checker:' || upper(event_type) AS code, 'x.xhtml' AS "where", 'user ' || user_id AS message FROM events WHERE event_type IN ('error', 'click')""")
def checker_messages(spark, sf):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "FATAL").when(kind == "click", "WARNING").otherwise("INFO")
    m = F.struct(F.upper(kind).alias("ID"), severity.alias("severity"), F.concat(F.lit("user "), "user_id").alias("message"), F.lit("x.xhtml").alias("path"))
    report = F.concat(F.lit("checking\n"), F.to_json(F.struct(F.array(m).alias("messages"))), F.lit("\ndone"))
    return lib.checker_messages(table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), report.alias("report")))


# --- upserts ---------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT doc_id, lang, 1 AS at FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, source AS lang, 2 AS at FROM documents WHERE doc_id % 3 <> 1)
SELECT doc_id, CASE WHEN n.at IS NOT NULL THEN n.lang ELSE o.lang END AS title, CAST(coalesce(o.at, n.at) AS INTEGER) AS imported_at FROM o FULL JOIN n USING (doc_id)""")
def doc_upsert(spark, sf):
    d = table(spark, sf, "documents")
    side = lambda keep, c, at: d.filter(keep).select("doc_id", F.col(c).alias("title"), F.lit(at).alias("imported_at"))
    return lib.upsert_docs(side("doc_id % 3 <> 0", "lang", 1), side("doc_id % 3 <> 1", "source", 2), ["title"])


@query(_CHAPTER + """SELECT doc_id, chapter, CASE WHEN chapter % 2 = 0 THEN 'new ' || title ELSE title END AS summary FROM chapter_text WHERE chapter % 3 <> 0 OR chapter % 2 = 0""")
def summary_upsert(spark, sf):
    c = sq.chapter_texts(_chapters(spark, sf), 6000).select("doc_id", "chapter", F.col("title").alias("summary"))
    old = c.filter("chapter % 3 <> 0").withColumn("seq", F.lit(9))
    fresh = c.filter("chapter % 2 = 0")
    new = fresh.select("doc_id", "chapter", F.lit("stale").alias("summary"), F.lit(1).alias("seq")).unionByName(fresh.select("doc_id", "chapter", F.concat(F.lit("new "), "summary").alias("summary"), F.lit(2).alias("seq")))
    return lib.upsert_latest(old, new, ["doc_id", "chapter"], ["summary"], "seq")


_STORED = SEGMENT + """, stored AS (SELECT text_hash, coalesce(source_lang, '') AS source_lang, min(text) AS translation, CAST(3 AS BIGINT) AS hits FROM segment WHERE doc_id % 4 = 0 GROUP BY ALL),
result AS (SELECT text_hash, coalesce(source_lang, '') AS source_lang, CASE WHEN ord % 5 = 0 THEN '' ELSE 'tr ' || text END AS translation, doc_id * 100000 + ord AS k FROM segment WHERE doc_id % 4 < 2),
fresh AS (SELECT text_hash, source_lang, arg_max(translation, k) AS fresh FROM result WHERE translation <> '' GROUP BY ALL)
"""


def _stored(spark, sf):
    s = segments(spark, sf).withColumn("target_lang", F.lit("zh"))
    key = ["text_hash", F.coalesce("source_lang", F.lit("")).alias("source_lang"), "target_lang"]
    stored = s.filter("doc_id % 4 = 0").groupBy(*key).agg(F.min("text").alias("translation")).withColumn("hits", F.lit(3).cast("long"))
    return s, stored


@query(_STORED + "SELECT text_hash, source_lang, 'zh' AS target_lang, coalesce(fresh, translation) AS translation, coalesce(hits, 0) AS hits FROM stored FULL JOIN fresh USING (text_hash, source_lang)")
def memory_upsert(spark, sf):
    s, stored = _stored(spark, sf)
    text = F.when(F.col("ord") % 5 == 0, "").otherwise(F.concat(F.lit("tr "), "text"))
    results = s.filter("doc_id % 4 < 2").select("text_hash", "source_lang", "target_lang", text.alias("translation"), (F.col("doc_id") * 100000 + F.col("ord")).alias("updated_at"))
    return lib.record_memory(stored, results)


@query(_MEMORY + """, more AS (SELECT text_hash, source_lang, count(*) AS n FROM carried GROUP BY ALL)
SELECT m.text_hash, m.source_lang, 3 + coalesce(n, 0) AS hits FROM memory m LEFT JOIN more USING (text_hash, source_lang)""")
def memory_hits(spark, sf):
    s = segments(spark, sf)
    memory = seg.memory_of(s.filter("doc_id % 2 = 0").withColumn("translation", F.concat(F.lit("tr "), "text"))).withColumn("hits", F.lit(3).cast("long"))
    return lib.add_hits(memory, _carried(spark, sf)).select("text_hash", "source_lang", "hits")


# --- decoding and small formats --------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS user, CASE WHEN event_id % 3 = 1 THEN 'not json ' || user_id END AS raw FROM events")
def job_decode(spark, sf):
    n = F.col("event_id")
    raw = F.when(n % 3 == 0, F.to_json(F.struct(F.col("user_id").alias("user")))).when(n % 3 == 1, F.concat(F.lit("not json "), "user_id"))
    return table(spark, sf, "events").select("event_id", lib.decode(raw, "user bigint").alias("d")).select("event_id", F.col("d.value.user").alias("user"), "d.raw")


@query(_UNIT + "SELECT doc_id, unit_id, text FROM unit")
def unit_text(spark, sf):
    b = blocks(spark, sf)
    ids = F.when(F.col("type") == "table", F.flatten(F.transform("rows", lambda row, r: F.transform(row, lambda x, c: F.format_string("%s:r%dc%d", "block_id", r, c))))).when(F.col("type").isin("heading", "paragraph"), F.array("block_id"))
    u = b.withColumn("unit_id", F.explode(ids))
    return u.select("doc_id", "unit_id", lib.unit_text(F.col("type"), F.col("text"), F.col("rows"), F.col("unit_id")).alias("text"))


@query("""WITH d AS (SELECT doc_id, string_split(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10)) AS ps FROM documents), p AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS seg, unnest(ps) AS part FROM d),
q AS (SELECT doc_id, seg, part, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(part) - length(regexp_replace(part, '^\\s+', '')) AS first FROM p)
SELECT doc_id, seg, CAST(first AS BIGINT) AS first FROM q WHERE regexp_matches(part, '\\S')""")
def first_glyphs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"))
    return lib.first_glyphs(d).select("doc_id", "seg", "first")


@query(_TERM + """SELECT term, concat_ws(chr(9), term, CAST(n AS VARCHAR), kind, replace(replace(replace(replace(sample, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), '') AS line FROM cand""")
def candidate_lines(spark, sf):
    return lib.candidate_lines(terms.candidates(_term_texts(spark, sf)))


_esc = lambda x: f"regexp_replace(regexp_replace({x}, '([\\\\#$*_`@<>\\[\\]~])', '\\\\\\1', 'g'), '(?m)^([-+/=])', '\\\\\\1', 'g')"


@query(BLOCK + f"""SELECT doc_id, block_id, '#table(columns: ' || list_max(list_transform(rows, lambda r: len(r))) || ', stroke: 0.4pt, inset: 5pt,' || chr(10) || CASE WHEN ord % 2 = 0 THEN '  caption: [' || block_id || '],' || chr(10) ELSE '' END
  || '  table.cell(rowspan: 2)[' || {_esc("rows[1][1]")} || '], ' || array_to_string(list_transform(flatten(rows)[2:], lambda x: '[' || {_esc("x")} || ']'), ', ') || ',' || chr(10) || ')' AS body
FROM block WHERE type = 'table' AND len(rows[1]) > 1""")
def typeset_table(spark, sf):
    b = blocks(spark, sf).filter((F.col("type") == "table") & (F.size(F.get("rows", 0)) > 1))
    spans = F.array(F.array(F.array(F.lit(2), F.lit(1))))
    return b.select("doc_id", "block_id", lib.typeset_table(F.col("rows"), spans, F.when(F.col("ord") % 2 == 0, F.col("block_id"))).alias("body"))


# --- comparison and estimates ----------------------------------------------------------------------------------------


@query(_GOLD + "SELECT count(*) AS n, count(*) FILTER (text IN (SELECT text FROM b)) AS hits, round(count(*) FILTER (text IN (SELECT text FROM b)) / count(*), 6)::DOUBLE AS share FROM a")
def golden_exact_hits(spark, sf):
    return golden.exact_hits(*_sides(spark, sf))


@query("""WITH w AS (SELECT unnest(string_split(text, ' ')) AS text FROM conversations), s AS (SELECT text, count(*) AS n FROM w WHERE length(text) <= 8 GROUP BY text)
SELECT 'short' AS kind, CAST(NULL AS VARCHAR) AS text, CAST(sum(n) AS BIGINT) AS n FROM s
UNION ALL SELECT 'latin', text, n FROM (SELECT text, n FROM s WHERE regexp_matches(text, '^[0-9A-Za-z\\x{ff10}-\\x{ff19}]{1,3}$') ORDER BY n DESC, text LIMIT 12)""")
def golden_short_parts(spark, sf):
    return golden.short_parts(table(spark, sf, "conversations").select(F.explode(F.split("text", " ")).alias("text")))


@query(_CHAPTER + """, own AS (SELECT CAST(floor(sum(greatest(1, CAST(floor(length(text) / 1.5) AS INTEGER))) * 1.4::DOUBLE) AS BIGINT) AS own FROM block WHERE type IN ('heading', 'paragraph') AND trim(text) <> ''),
extra AS (SELECT CAST(sum(greatest(1, CAST(floor(length(title) / 1.5) AS INTEGER))) AS BIGINT) AS extra FROM chapter_text WHERE title <> ''), est AS (SELECT own.own + extra.extra AS tokens_in FROM own, extra)
SELECT tokens_in, CAST(floor(tokens_in * 0.7::DOUBLE) AS BIGINT) AS tokens_out, round((tokens_in * 2.0::DOUBLE + floor(tokens_in * 0.7::DOUBLE) * 8.0::DOUBLE) / 1e6, 8)::DOUBLE AS cost FROM est""")
def run_estimate(spark, sf):
    contexts = sq.chapter_texts(_chapters(spark, sf), 6000).select(F.col("title").alias("text"))
    return sq.estimate(segments(spark, sf), 2.0, 8.0, contexts)
