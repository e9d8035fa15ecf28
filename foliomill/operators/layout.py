"""Page layout: running heads, page numbers, paragraphs, ruby and writing direction.

Inputs are page_row(doc_id, page, row, text, off, y, x, h) and page_char(doc_id, page, pos, ch, x0, y0, x1, y1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliomill.functions import fixed as X
from foliomill.functions import text as t

DEFAULT_HEIGHT = 12.0


def char_height(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median of character heights above 0.5, or 12."""
    hs = F.collect_list(F.when(F.col("y1") - F.col("y0") > 0.5, F.col("y1") - F.col("y0")))
    return boxes.groupBy(*keys).agg(F.coalesce(t.upper_median(hs), F.lit(DEFAULT_HEIGHT)).alias("height"))


def displacements(chars: DataFrame, most: int = 400) -> DataFrame:
    """dx, dy between neighbouring characters of a page, for its first characters."""
    w = W.partitionBy("doc_id", "page").orderBy("pos")
    d = chars.filter(F.col("pos") < most).select("doc_id", "page", "pos", (F.col("x0") - F.lag("x0").over(w)).alias("dx"), (F.col("y0") - F.lag("y0").over(w)).alias("dy"))
    return d.filter("dx is not null")


def vertical(moves: DataFrame) -> DataFrame:
    """doc_id, vertical: the median vertical step is over 1.5 times the horizontal one."""
    m = moves.filter(F.abs("dx") + F.abs("dy") > 0.01).groupBy("doc_id").agg(F.percentile(F.abs("dx"), 0.5).alias("dx"), F.percentile(F.abs("dy"), 0.5).alias("dy"))
    every = moves.select("doc_id").distinct().join(m, "doc_id", "left")
    return every.select("doc_id", F.coalesce(F.col("dy") > F.col("dx") * 1.5, F.lit(False)).alias("vertical"))


def page_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))


def page_number_rows(rows: DataFrame, tol: float = 8.0, min_pages: int = 3, min_ratio: float = 0.02) -> DataFrame:
    """doc_id, bucket: heights at which page numbers stand on enough pages. Half-even rounding."""
    need = F.greatest(F.lit(min_pages), F.floor(F.col("pages") * min_ratio).cast("int"))
    hits = rows.filter(t.is_page_number("text")).groupBy("doc_id", F.rint(F.col("y") / tol).cast("int").alias("bucket")).agg(F.count_distinct("page").alias("n"))
    return hits.join(page_counts(rows), "doc_id").filter(F.col("n") >= need).select("doc_id", "bucket", "n")


def running_heads(candidates: DataFrame, pages: DataFrame, min_ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """doc_id, text: texts (no numbers) that are margin candidates on enough pages."""
    need = F.greatest(F.lit(min_pages), F.floor(F.col("pages") * min_ratio).cast("int"))
    hits = candidates.filter(~t.is_page_number("text")).groupBy("doc_id", "text").agg(F.count_distinct("page").alias("n"))
    return hits.join(pages, "doc_id").filter(F.col("n") >= need).select("doc_id", "text", "n")


def _with_margin(rows: DataFrame, axis: str = "y", band: float = 0.06, gap_ratio: float = 1.6, max_len: int = 30) -> DataFrame:
    """rows with a column margin: short rows in the outer band of a page, 1.6 median gaps or more from every other row.

    Blank rows are windowed apart from the others, so that they count for nothing.
    """
    page = W.partitionBy("doc_id", "page", "_live")
    order = page.orderBy(axis, "row")
    c = F.col(axis)
    live = rows.withColumn("_live", F.coalesce(F.trim("text") != "", F.lit(False)))
    live = live.withColumn("_n", F.count(F.lit(1)).over(page)).withColumn("_lo", F.min(c).over(page)).withColumn("_hi", F.max(c).over(page))
    live = live.withColumn("_step", c - F.lag(c).over(order)).withColumn("_next", F.lead(c).over(order) - c)
    live = live.withColumn("_med", F.percentile(F.when(F.col("_step") > 0.01, F.col("_step")), 0.5).over(page))
    far = F.lit(float("inf"))
    alone = F.least(F.coalesce("_step", far), F.coalesce("_next", far))
    pos = (c - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    ok = F.col("_live") & (F.col("_n") >= 3) & (F.length("text") <= max_len) & ~t.is_page_number("text") & ~((pos > band) & (pos < 1.0 - band)) & (alone >= F.col("_med") * gap_ratio)
    return live.withColumn("margin", F.coalesce(ok, F.lit(False))).drop("_live", "_n", "_lo", "_hi", "_step", "_next", "_med")


def margin_rows(rows: DataFrame, axis: str = "y", band: float = 0.06, gap_ratio: float = 1.6, max_len: int = 30) -> DataFrame:
    """Short rows in the outer band of a page, apart from every other row by 1.6 median gaps or more."""
    return _with_margin(rows, axis, band, gap_ratio, max_len).filter("margin").select("doc_id", "page", "row", "text")


def without_headers(rows: DataFrame, head_ratio: float = 0.05, number_ratio: float = 0.02, min_pages: int = 3, tol: float = 8.0) -> DataFrame:
    """Rows that are neither a running head nor a page number: the rules of running_heads and page_number_rows in one pass.

    Rows are dealt by document once; every window is of a document or a part of one, so none needs a shuffle of its own.
    """
    distinct_pages = lambda when, *by: F.size(F.collect_set(F.when(when, F.col("page"))).over(W.partitionBy("doc_id", *by)))
    need = lambda ratio: F.greatest(F.lit(min_pages), F.floor(F.col("_pages") * ratio).cast("int"))
    number = F.when(t.is_page_number("text"), F.rint(F.col("y") / tol).cast("int"))
    flagged = _with_margin(rows.repartition("doc_id")).withColumn("_bucket", number).withColumn("_pages", distinct_pages(F.lit(True)))
    flagged = flagged.withColumn("_heads", distinct_pages(F.col("margin"), "text")).withColumn("_numbers", distinct_pages(F.col("_bucket").isNotNull(), "_bucket"))
    drop = (F.col("margin") & (F.col("_heads") >= need(head_ratio))) | (F.col("_bucket").isNotNull() & (F.col("_numbers") >= need(number_ratio)))
    return flagged.filter(~drop).select(*rows.columns)


def paragraphs(rows: DataFrame, height: float = DEFAULT_HEIGHT, vertical: bool = False) -> DataFrame:
    """doc_id, para, text: a row that starts (by its indent) opens a paragraph, others are joined to the open one."""
    clean = rows.withColumn("clean", t.clean_pdf_text("text")).filter("clean <> ''")
    starts = (t.segment_kind(F.col("off"), F.lit(height)) == "start").cast("int")
    w = W.partitionBy("doc_id").orderBy("page", "row")
    first = F.row_number().over(w) == 1
    para = F.sum(F.when(first, 1).otherwise(starts)).over(w.rowsBetween(W.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.struct("page", "row", "clean")))
    joined = F.aggregate("parts", F.lit(""), lambda acc, p: t.join_wrapped(acc, p["clean"], vertical))
    out = clean.withColumn("para", para).groupBy("doc_id", "para").agg(parts.alias("parts"))
    return out.select("doc_id", "para", t.clean_paragraph(joined).alias("text"))


def wide_gaps(rows: DataFrame) -> DataFrame:
    """off raised to the height where the gap to the row before is over 1.6 median gaps plus 0.4 heights."""
    w = W.partitionBy("doc_id", "page").orderBy("row")
    gap = F.lag("y").over(w) - F.col("y")
    g = rows.withColumn("gap", gap).withColumn("med", F.percentile("gap", 0.5).over(W.partitionBy("doc_id", "page")))
    return g.withColumn("off", F.when(F.col("gap") > F.col("med") * 1.6 + F.col("h") * 0.4, F.greatest("off", "h")).otherwise(F.col("off"))).drop("gap", "med")


def strip_ruby(chars: DataFrame, ratio: float = 0.75, strong: float = 0.56) -> DataFrame:
    """Characters without inline ruby: runs of two or more small kana, and single very small kana next to a kanji.

    chars: with column h, the page's character height. White space does not break a run: it is windowed apart. A run is
    longer than one where a neighbour is small too, so one order is enough, and rows are dealt by page once.
    """
    high = F.col("y1") - F.col("y0")
    kana = F.col("ch").rlike(f"^[{X.KANA}]$") & (high > 0)
    w = W.partitionBy("doc_id", "page", "_live").orderBy("pos")
    live = F.coalesce(~F.col("ch").rlike(f"^[{X.WS}]$"), F.lit(False))
    s = chars.withColumns({"_live": live, "_small": kana & (high < F.col("h") * ratio), "_tiny": kana & (high < F.col("h") * strong), "_kanji": F.col("ch").rlike(f"^[{X.KANJI}]$")})
    s = s.repartition("doc_id", "page")
    beside = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False)) | F.coalesce(F.lead(c).over(w), F.lit(False))
    s = s.withColumns({"_run": beside("_small"), "_near": beside("_kanji")})
    drop = F.col("_live") & F.col("_small") & (F.col("_run") | (F.col("_tiny") & F.col("_near")))
    return s.filter(~F.coalesce(drop, F.lit(False))).select(*chars.columns)


def matter_by_page(pages: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """doc_id, page, matter: the last bookmark's matter carried forward."""
    marks = bookmarks.groupBy("doc_id", "page").agg(F.max_by(t.classify_matter(F.lit(""), "title"), "pos").alias("mark"))
    w = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    j = pages.join(marks, ["doc_id", "page"], "left")
    return j.select("doc_id", "page", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit("main")).alias("matter"))


def header_report(rows: DataFrame, top: int = 20) -> DataFrame:
    """The most repeated row texts: pages, median and spread of y, median x."""
    by = rows.filter(F.trim("text") != "").groupBy("text").agg(
        F.count_distinct("doc_id", "page").alias("pages"), F.round(F.percentile("y", 0.5), 4).alias("y_median"), F.round(F.stddev_pop("y"), 4).alias("y_spread"), F.round(F.percentile("x", 0.5), 4).alias("x_median")
    )
    return by.filter("pages >= 3").orderBy(F.desc("pages"), "text").limit(top)


def height_histogram(rows: DataFrame) -> DataFrame:
    """Row heights against the document's upper median, by tenths."""
    med = rows.groupBy("doc_id").agg(t.upper_median(F.collect_list("h")).alias("med"))
    ratio = F.round(F.col("h") / F.col("med"), 1)
    return rows.join(med, "doc_id").groupBy(ratio.alias("ratio")).agg(F.count(F.lit(1)).alias("n"))
