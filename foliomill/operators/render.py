"""Output documents: previews, chapters, navigation and typesetting source, as ordered string assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliomill.functions import text as t

from .sequence import render_chapters


def escape_xml(col: Column) -> Column:
    out = t.text_of(col)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def joined(rows: DataFrame, keys: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """One string a key: the lines in order of ord, nulls left out."""
    parts = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col("ord"), line.alias("line")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["line"]), sep).alias("body"))


def preview_line() -> Column:
    hashes = F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(1)) + 1, F.lit(6)))
    return (
        F.when(F.col("type") == "heading", F.concat(hashes, F.lit(" "), "text"))
        .when(F.col("type") == "paragraph", F.col("text"))
        .when(F.col("type") == "image", F.concat(F.lit("![image]("), F.col("block_id"), F.lit(")")))
        .when(F.col("type") == "footnote", F.concat(F.lit("> [note] "), "text"))
        .otherwise(F.concat(F.lit("<!-- "), "type", F.lit(" -->")))
    )


def markdown(blocks: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, body: a preview of the first blocks, with the number of those left out."""
    w = W.partitionBy("doc_id").orderBy("ord")
    rows = blocks.withColumn("line", preview_line())
    if limit is not None:
        n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
        rows = rows.withColumn("rn", F.row_number().over(w)).withColumn("n", n).filter(F.col("rn") <= limit + 1)
        rest = F.concat(F.lit("… "), (F.col("n") - limit).cast("string"), F.lit(" more blocks"))
        rows = rows.withColumn("line", F.when(F.col("rn") > limit, rest).otherwise(F.col("line")))
    return joined(rows, ["doc_id"], F.col("line"), "\n\n")


def summary(blocks: DataFrame) -> DataFrame:
    """doc_id, summary: one line of counts."""
    of = lambda k: F.count_if(F.col("type") == k)
    return blocks.groupBy("doc_id").agg(F.format_string("blocks %d (headings %d / paragraphs %d / images %d)", F.count(F.lit(1)), of("heading"), of("paragraph"), of("image")).alias("summary"))


def note_marks(refs: Column) -> Column:
    return F.array_join(F.transform(refs, lambda r, i: F.concat(F.lit('<sup><a href="#'), r, F.lit('" class="noteref">['), (i + 1).cast("string"), F.lit("]</a></sup>"))), "")


def element(mode: str) -> Column:
    """XHTML of a block; translation in column tgt. In target mode untranslated paragraphs are left out (null)."""
    tgt = F.trim(t.text_of("tgt"))
    level = F.least(F.coalesce("level", F.lit(1)), F.lit(4)).cast("string")
    head = F.concat(F.lit("<h"), level, F.lit(">"), escape_xml(F.col("text")), F.lit("</h"), level, F.lit(">"))
    src = F.concat(F.lit('<p class="bi-src">'), escape_xml(F.col("text")), F.lit("</p>"))
    both = F.concat(F.lit('<div class="bi">'), src, F.when(tgt != "", F.concat(F.lit('<p class="bi-tgt">'), escape_xml(tgt), F.lit("</p>"))).otherwise(F.lit("")), F.lit("</div>"))
    para = F.when(tgt != "", F.concat(F.lit("<p>"), escape_xml(tgt), F.lit("</p>"))) if mode == "target" else both
    image = F.concat(F.lit('<figure><img src="../images/'), "block_id", F.lit('"/></figure>'))
    cell = lambda c: F.concat(F.lit("<td>"), escape_xml(c), F.lit("</td>"))
    tr = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))
    table = F.concat(F.lit('<table class="tbl">'), F.array_join(F.transform("rows", tr), ""), F.lit("</table>"))
    return F.when(F.col("type") == "heading", head).when(F.col("type") == "image", image).when(F.col("type") == "table", table).when(F.col("type").isin("paragraph", "footnote"), para)


def chapters(blocks: DataFrame, translations: DataFrame, mode: str = "bilingual") -> DataFrame:
    """doc_id, part, title, body. translations: (doc_id, block_id, tgt). A part without output is left out."""
    rows = render_chapters(blocks).join(translations, ["doc_id", "block_id"], "left").withColumn("xml", element(mode))
    out = joined(rows.filter("xml is not null"), ["doc_id", "part"], F.col("xml"), "")
    heads = rows.filter("type = 'heading'").select("doc_id", "part", F.col("text").alias("title"))
    return out.join(heads, ["doc_id", "part"], "left").select("doc_id", "part", "title", "body")


def navigation(chapters: DataFrame) -> DataFrame:
    """doc_id, body: the list of chapters."""
    item = F.concat(F.lit('<li><a href="text/ch'), F.lpad(F.col("part").cast("string"), 4, "0"), F.lit('.xhtml">'), escape_xml(F.col("title")), F.lit("</a></li>"))
    return joined(chapters.withColumnRenamed("part", "part").withColumn("ord", F.col("part")), ["doc_id"], item, "")


def coverage(units: DataFrame, translations: DataFrame) -> DataFrame:
    """doc_id, units, translated, complete. translations: (doc_id, unit_id, tgt); blank counts as missing."""
    t_ = translations.filter(F.trim(t.text_of("tgt")) != "").select("doc_id", "unit_id", F.lit(1).alias("hit")).distinct()
    j = units.join(t_, ["doc_id", "unit_id"], "left")
    out = j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.coalesce("hit", F.lit(0))).alias("translated"))
    return out.withColumn("complete", F.col("units") == F.col("translated"))


def typeset(blocks: DataFrame) -> DataFrame:
    """doc_id, body: typesetting source of headings and paragraphs."""
    line = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("="), F.coalesce("level", F.lit(1))), F.lit(" "), t.typeset_escape("text"))).when(F.col("type") == "paragraph", t.typeset_escape("text"))
    return joined(blocks, ["doc_id"], line, "\n\n")
