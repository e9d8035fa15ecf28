"""Page layout over lines of documents laid out on pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliomill.functions import text as t
from foliomill.operators import layout
from foliomill.sources.tables import HIRAGANA_FROM, HIRAGANA_TO, page_rows, table

from .registry import PAGE_ROW, kana, page_number, query

_NUMBERS = PAGE_ROW + f""", num AS (
  SELECT doc_id, CAST(round_even(y / 8.0, 0) AS INTEGER) AS bucket, count(DISTINCT page) AS n FROM page_row WHERE {page_number('text')} GROUP BY ALL
), number_row AS (SELECT num.doc_id, bucket, n FROM num JOIN pages USING (doc_id) WHERE n >= greatest(3, CAST(floor(pages * 0.02) AS INTEGER)))
"""

_MARGIN = _NUMBERS + f""", live AS (
  SELECT *, count(*) OVER p AS n, min(y) OVER p AS lo, max(y) OVER p AS hi, y - lag(y) OVER o AS back, lead(y) OVER o - y AS ahead
  FROM page_row WHERE trim(text) <> '' WINDOW p AS (PARTITION BY doc_id, page), o AS (PARTITION BY doc_id, page ORDER BY y, row)
), spaced AS (
  SELECT *, median(CASE WHEN back > 0.01 THEN back END) OVER (PARTITION BY doc_id, page) AS med, least(coalesce(back, 'inf'::DOUBLE), coalesce(ahead, 'inf'::DOUBLE)) AS alone FROM live
), margin AS (
  SELECT doc_id, page, row, text FROM spaced
  WHERE n >= 3 AND med IS NOT NULL AND length(text) <= 30 AND NOT {page_number('text')} AND hi > lo AND NOT ((y - lo) / (hi - lo) > 0.06 AND (y - lo) / (hi - lo) < 0.94) AND alone >= med * 1.6
), head AS (
  SELECT doc_id, text, n FROM (SELECT doc_id, text, count(DISTINCT page) AS n FROM margin GROUP BY ALL) JOIN pages USING (doc_id) WHERE n >= greatest(3, CAST(floor(pages * 0.05) AS INTEGER))
)
"""


@query(PAGE_ROW + "SELECT doc_id, page, coalesce(list_sort(list(h))[(count(h) // 2) + 1], 12.0) AS height FROM page_row GROUP BY ALL")
def char_height(spark, sf):
    boxes = page_rows(spark, sf).select("doc_id", "page", F.lit(0.0).alias("y0"), F.col("h").alias("y1"))
    return layout.char_height(boxes, ["doc_id", "page"])


@query(PAGE_ROW + """, m AS (SELECT doc_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM page_row WHERE row < 400 WINDOW w AS (PARTITION BY doc_id, page ORDER BY row)),
k AS (SELECT doc_id, median(abs(dx)) AS dx, median(abs(dy)) AS dy FROM m WHERE dx IS NOT NULL AND abs(dx) + abs(dy) > 0.01 GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.dy > k.dx * 1.5, false) AS vertical FROM (SELECT DISTINCT doc_id FROM m WHERE dx IS NOT NULL) d LEFT JOIN k USING (doc_id)""")
def vertical_flag(spark, sf):
    chars = page_rows(spark, sf).select("doc_id", "page", F.col("row").alias("pos"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    return layout.vertical(layout.displacements(chars))


@query(_NUMBERS + "SELECT doc_id, bucket, n FROM number_row")
def page_number_rows(spark, sf):
    return layout.page_number_rows(page_rows(spark, sf))


@query(_MARGIN + "SELECT doc_id, page, row, text FROM margin")
def margin_rows(spark, sf):
    return layout.margin_rows(page_rows(spark, sf))


@query(_MARGIN + "SELECT doc_id, text, n FROM head")
def running_heads(spark, sf):
    rows = page_rows(spark, sf)
    return layout.running_heads(layout.margin_rows(rows), layout.page_counts(rows))


@query(_MARGIN + f"""SELECT p.doc_id, p.page, p.row, p.text FROM page_row p
ANTI JOIN (SELECT doc_id, page, row FROM margin SEMI JOIN head USING (doc_id, text)) m ON p.doc_id = m.doc_id AND p.page = m.page AND p.row = m.row
ANTI JOIN number_row b ON p.doc_id = b.doc_id AND {page_number('p.text')} AND CAST(round_even(p.y / 8.0, 0) AS INTEGER) = b.bucket""")
def header_filter(spark, sf):
    return layout.without_headers(page_rows(spark, sf)).select("doc_id", "page", "row", "text")


@query(PAGE_ROW + """, c AS (SELECT doc_id, page, row, off, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM page_row WHERE row BETWEEN 1 AND 40), w AS (SELECT * FROM c WHERE clean <> ''),
s AS (SELECT *, sum(CASE WHEN k = 1 THEN 1 WHEN off >= 3.6 AND off < 21.6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, row) AS para FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, row) AS k FROM w))
SELECT doc_id, CAST(para AS BIGINT) AS para, string_agg(clean, ' ' ORDER BY page, row) AS text FROM s GROUP BY ALL""")
def paragraphs(spark, sf):
    return layout.paragraphs(page_rows(spark, sf).filter("row between 1 and 40"))


@query(PAGE_ROW + """, g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY row) - y AS gap FROM page_row),
k AS (SELECT *, median(gap) OVER (PARTITION BY doc_id, page) AS med FROM g)
SELECT doc_id, page, row, CASE WHEN gap > med * 1.6 + h * 0.4 THEN greatest(off, h) ELSE off END AS off FROM k""")
def line_gaps(spark, sf):
    return layout.wide_gaps(page_rows(spark, sf)).select("doc_id", "page", "row", "off")


_RUBY = f"""
WITH c AS (SELECT conv_id AS doc_id, turn AS page, string_split({kana('text')} || '学や', '') AS cs FROM conversations),
ch AS (SELECT doc_id, page, generate_subscripts(cs, 1) AS pos, unnest(cs) AS ch FROM c),
b AS (SELECT *, CASE WHEN pos % 7 IN (0, 1, 2) THEN 6.0 WHEN pos % 7 = 3 THEN 7.4 ELSE 12.0 END AS height FROM ch WHERE ch <> ''),
seen AS (SELECT *, regexp_matches(ch, '^[ぁ-ゟァ-ヶ]$') AND height < 9.0 AS small, regexp_matches(ch, '^[ぁ-ゟァ-ヶ]$') AND height < 6.72 AS tiny,
  lag(ch) OVER w AS before, lead(ch) OVER w AS after, row_number() OVER w AS k FROM b WHERE NOT regexp_matches(ch, '^\\s$') WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, page, small ORDER BY pos) AS run FROM seen),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, small, run) AS len FROM r),
gone AS (SELECT doc_id, page, pos FROM n WHERE small AND (len >= 2 OR (tiny AND (coalesce(regexp_matches(before, '^[㐀-䶿一-鿿豈-﫿]$'), false) OR coalesce(regexp_matches(after, '^[㐀-䶿一-鿿豈-﫿]$'), false)))))
"""


@query(_RUBY + "SELECT doc_id, page, count(*) AS kept, string_agg(ch, '' ORDER BY pos) AS text FROM b ANTI JOIN gone USING (doc_id, page, pos) GROUP BY ALL")
def ruby_strip(spark, sf):
    base = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split(F.concat(F.translate("text", HIRAGANA_FROM, HIRAGANA_TO), F.lit("学や")), "")).alias("p", "ch"))
    chars = base.filter("ch <> ''").withColumn("pos", F.col("p") + 1)
    high = F.when((F.col("pos") % 7).isin(0, 1, 2), 6.0).when(F.col("pos") % 7 == 3, 7.4).otherwise(12.0)
    kept = layout.strip_ruby(chars.select("doc_id", "page", "pos", "ch", F.lit(0.0).alias("y0"), high.alias("y1"), F.lit(12.0).alias("h")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "ch")))
    return kept.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("kept"), F.array_join(F.transform(parts, lambda x: x["ch"]), "").alias("text"))


@query(PAGE_ROW + """, m AS (SELECT doc_id, list_sort(list(h))[(count(h) // 2) + 1] AS med FROM page_row GROUP BY doc_id)
SELECT round(h / med, 1)::DOUBLE AS ratio, count(*) AS n FROM page_row JOIN m USING (doc_id) GROUP BY 1""")
def ruby_hist(spark, sf):
    return layout.height_histogram(page_rows(spark, sf))


_TITLES = ("表紙", "目次", "第一章", "あとがき", "奥付")
_title = "CASE page % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_TITLES)) + " END"


@query(PAGE_ROW + f""", pg AS (SELECT DISTINCT doc_id, page FROM page_row), mk AS (
  SELECT doc_id, page, CASE {_title} WHEN '表紙' THEN 'cover' WHEN '目次' THEN 'toc' WHEN 'あとがき' THEN 'afterword' WHEN '奥付' THEN 'colophon' ELSE 'main' END AS mark FROM pg WHERE page % 2 = 0)
SELECT doc_id, page, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page), 'main') AS matter FROM pg LEFT JOIN mk USING (doc_id, page)""")
def matter_carry(spark, sf):
    pages = page_rows(spark, sf).select("doc_id", "page").distinct()
    title = F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("page") % 5 + 1).cast("int"))
    return layout.matter_by_page(pages, pages.filter("page % 2 = 0").select("doc_id", "page", F.lit(0).alias("pos"), title.alias("title")))


@query(PAGE_ROW + """SELECT text, count(DISTINCT (doc_id, page)) AS pages, round(median(y), 4)::DOUBLE AS y_median, round(stddev_pop(y), 4)::DOUBLE AS y_spread, round(median(x), 4)::DOUBLE AS x_median
FROM page_row WHERE trim(text) <> '' GROUP BY text HAVING count(DISTINCT (doc_id, page)) >= 3 ORDER BY pages DESC, text LIMIT 20""")
def header_candidates(spark, sf):
    return layout.header_report(page_rows(spark, sf))


@query(PAGE_ROW + """, k AS (SELECT doc_id, median(h) AS med FROM page_row GROUP BY doc_id), p AS (SELECT doc_id, max(row) AS m FROM page_row GROUP BY doc_id)
SELECT round(row / m, 1)::DOUBLE AS pos, count(*) AS n FROM page_row JOIN k USING (doc_id) JOIN p USING (doc_id) WHERE h < med GROUP BY 1""")
def footnote_candidates(spark, sf):
    rows = page_rows(spark, sf)
    m = rows.groupBy("doc_id").agg(F.percentile("h", 0.5).alias("med"), F.max("row").alias("m"))
    return rows.join(m, "doc_id").filter("h < med").groupBy(F.round(F.col("row") / F.col("m"), 1).alias("pos")).agg(F.count(F.lit(1)).alias("n"))


@query(PAGE_ROW + "SELECT doc_id, page, row, CASE WHEN off < 3.6 THEN 'cont' WHEN off < 21.6 THEN 'start' ELSE 'inner' END AS kind, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY row) AS dy FROM page_row")
def segment_kinds(spark, sf):
    dy = F.col("y") - F.lag("y").over(W.partitionBy("doc_id", "page").orderBy("row"))
    return page_rows(spark, sf).select("doc_id", "page", "row", t.segment_kind(F.col("off"), F.lit(12.0)).alias("kind"), dy.alias("dy"))
