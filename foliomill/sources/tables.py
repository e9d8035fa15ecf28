"""The canonical tables, built from the driver's tables: blocks, segments, pairs, page rows and job events.

Blocks come from document lines by arithmetic on the line number, so that every block type occurs. The text tables hold
no CJK text; where a rule needs it, vowels are exchanged for kana, the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from foliomill.functions import text as t

HIRAGANA_FROM, HIRAGANA_TO = "aeiou", "あえいおう"
KATAKANA_FROM, KATAKANA_TO = "aei", "アエイ"
PATHS = ("p-cover", "p-fmatter-001", "p-toc-001", "p-001", "p-002", "p-003", "p-afterword", "p-allcover-001", "p-colophon", "p-promo", "x", "")
LINES_PER_PAGE = 40

# Schemas as DDL: parsing one needs a session, and importing this module must not.
DOC = "doc_id string, title string, author string, publisher string, source_lang string, origin string, vertical boolean, ruby_dropped int, page_count int, spine_docs int"
BLOCK = (
    "doc_id string, ord int, block_id string, type string, level int, text string, spans array<struct<kind:string,text:string>>, src string,"
    " source_ref string, path string, caption string, matter string, rows array<array<string>>, cell_spans array<array<array<int>>>, note_id string, refs array<string>"
)
TOC = "doc_id string, pos int, level int, title string, href string, block_id string"


def book_schema() -> T.StructType:
    """One book as nested JSON."""
    field, parse = T.StructField, T.StructType.fromDDL
    return T.StructType([field("schema_version", T.StringType()), field("doc", parse(DOC)), field("toc", T.ArrayType(parse(TOC))), field("blocks", T.ArrayType(parse(BLOCK)))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Books as nested JSON, one file each; a file that does not fit the schema stops the read."""
    return spark.read.schema(book_schema()).option("multiLine", True).option("mode", "FAILFAST").json(path)


def by_doc(*order: str) -> W:
    return W.partitionBy("doc_id").orderBy(*(order or ("ord",)))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ord, block_id, text, type, level, path_hint, rows. Needs no shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split("text", "\n").alias("ls"))
    head = F.array_position(F.transform("ls", lambda x: F.trim(x) != ""), True)
    raw = docs.withColumn("head", head).select("doc_id", "lang", "source", "head", F.posexplode("ls").alias("pos", "text"))
    ord_ = F.col("pos") + 1
    kind = (
        F.when(F.trim("text") == "", "paragraph")
        .when((ord_ == F.col("head")) | (ord_ % 12 == 1), "heading")
        .when(ord_ % 17 == 0, "image")
        .when(ord_ % 19 == 0, "table")
        .otherwise("paragraph")
    )
    level = F.when(F.col("type") == "heading", F.when((F.col("ord") == F.col("head")) | (F.col("ord") % 24 == 1), 1).otherwise(2))
    rows = F.when(F.col("type") == "table", F.array(F.slice(F.split("text", " "), 1, 2), F.slice(F.split("text", " "), 3, 2)))
    return raw.withColumn("ord", ord_.cast("int")).withColumn("type", kind).select(
        "doc_id", "lang", "source", "ord", F.format_string("b%06d", "ord").alias("block_id"), "text", "type", level.alias("level"),
        F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.pmod("doc_id", F.lit(12)) + 1).cast("int")).alias("path_hint"), rows.alias("rows"),
    )


def with_matter(rows: DataFrame) -> DataFrame:
    return rows.withColumn("matter", t.classify_matter("path_hint", F.lit("")))


def translatable() -> Column:
    any_cell = F.exists(F.flatten("rows"), lambda c: F.trim(c) != "")
    return F.when(F.col("type") == "table", F.coalesce(any_cell, F.lit(False))).otherwise(F.col("type").isin("heading", "paragraph", "footnote") & (F.trim("text") != ""))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text segments of documents: blocks that are no image or table, with their hash."""
    b = blocks(spark, sf_dir).filter(F.col("type").isin("heading", "paragraph") & (F.trim("text") != ""))
    return b.select(F.concat_ws(":", F.col("doc_id").cast("string"), "block_id").alias("seg_id"), "doc_id", "block_id", "ord", "type", "text", F.col("lang").alias("source_lang"), t.text_hash("text").alias("text_hash"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target of conversation turns: seg_id, conv_id, turn, source, target, status, kana in a known share."""
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    kana = F.translate("text", HIRAGANA_FROM, HIRAGANA_TO)
    kata = F.translate("answer", KATAKANA_FROM, KATAKANA_TO)
    target = (
        F.when(F.col("turn") % 8 == 0, kana)
        .when(F.col("turn") % 8 == 1, F.translate("answer", HIRAGANA_FROM, HIRAGANA_TO))
        .when(F.col("turn") % 8 == 2, kata)
        .when(F.col("turn") % 8 == 3, F.concat(F.lit("們這說 "), F.col("answer")))
        .when(F.col("turn") % 8 == 4, F.substring("answer", 1, 3))
        .otherwise(F.col("answer"))
    )
    status = F.when(F.col("turn") % 3 == 0, "pending").otherwise("done")
    return turns.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("seg_id"), "conv_id", "turn", kana.alias("source"), F.coalesce(target, F.lit("")).alias("target"), status.alias("status"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, row, text, off, y, x, h: lines laid out on pages, with a head and a page number on each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    body = docs.select(
        "doc_id", F.floor(F.col("pos") / LINES_PER_PAGE).cast("int").alias("page"), (F.col("pos") % LINES_PER_PAGE + 1).cast("int").alias("row"), "text",
        F.when(F.col("pos") % 5 == 0, 14.0).otherwise(0.0).alias("off"), (F.lit(700.0) - (F.col("pos") % LINES_PER_PAGE) * 12).cast("double").alias("y"), F.lit(60.0).alias("x"), (F.lit(10.0) + F.col("pos") % 3).cast("double").alias("h"), "source",
    )
    first = body.filter("row = 1")
    heads = first.select("doc_id", "page", F.lit(0).alias("row"), F.concat(F.lit("Head "), "source").alias("text"), F.lit(0.0).alias("off"), F.lit(760.0).alias("y"), F.lit(60.0).alias("x"), F.lit(10.0).alias("h"), "source")
    feet = first.select("doc_id", "page", F.lit(99).alias("row"), (F.col("page") + 1).cast("string").alias("text"), F.lit(0.0).alias("off"), F.lit(42.0).alias("y"), F.lit(300.0).alias("x"), F.lit(10.0).alias("h"), "source")
    return body.unionByName(heads).unionByName(feet)


def tenths(value: Column) -> Column:
    """The fractional part of a value, cut to tenths."""
    return F.floor((value - F.floor(value)) * 10) / 10.0


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, seq, ts, status, progress, pid from the event table."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"),
        tenths(F.col("value")).alias("progress"), F.pmod("user_id", F.lit(17)).alias("pid"),
    )
