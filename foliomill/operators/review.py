"""The review loop: export, classify and apply edits, and undo them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as t

HEADER = "seg_id\tstatus\tsource\ttranslation"


def export_lines(segments: DataFrame) -> DataFrame:
    """doc_id, ord, line: the tab-separated review lines in order."""
    text = F.coalesce("final", "translation")
    return segments.select("doc_id", "ord", F.concat_ws("\t", "seg_id", "status", t.tsv_escape("source"), t.tsv_escape(text)).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines: (line_no, line). Blank lines, comments and the header are skipped; under four cells there is no text."""
    rows = lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("seg_id\t")).withColumn("cells", F.split("line", "\t", -1))
    return rows.select("line_no", F.get("cells", 0).alias("seg_id"), F.when(F.size("cells") >= 4, t.tsv_unescape(F.get("cells", 3))).alias("text"))


def classify(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """line_no, seg_id, text, result: unknown, blank, unchanged or updated."""
    s = segments.select("seg_id", F.coalesce("final", "translation", F.lit("")).alias("now"), F.lit(True).alias("known"))
    result = F.when(F.col("known").isNull() | F.col("text").isNull(), "unknown").when(F.trim("text") == "", "blank").when(F.col("text") == F.col("now"), "unchanged").otherwise("updated")
    return edits.join(s, "seg_id", "left").select("line_no", "seg_id", "text", result.alias("result"))


def apply_edits(segments: DataFrame, classified: DataFrame) -> DataFrame:
    """Segments with the updated texts as final and status reviewed; of several edits the last counts."""
    e = classified.filter("result = 'updated'").groupBy("seg_id").agg(F.max_by("text", "line_no").alias("edit"))
    j = segments.join(e, "seg_id", "left")
    return j.withColumn("final", F.coalesce("edit", "final")).withColumn("status", F.when(F.col("edit").isNotNull(), "reviewed").otherwise(F.col("status"))).drop("edit")


def clear(segments: DataFrame) -> DataFrame:
    """Drop all reviewed texts; their segments are done again."""
    had = F.col("final").isNotNull()
    return segments.withColumn("status", F.when(had, "done").otherwise(F.col("status"))).withColumn("final", F.lit(None).cast("string"))


def patch(segments: DataFrame, seg_id: str, text: str | None) -> DataFrame:
    """Set or clear one segment's reviewed text; its status stays."""
    return segments.withColumn("final", F.when(F.col("seg_id") == seg_id, F.lit(text).cast("string")).otherwise(F.col("final")))


def markdown(segments: DataFrame) -> DataFrame:
    text = F.coalesce("final", "translation", F.lit(""))
    return segments.select("doc_id", "ord", F.concat(F.lit("### `"), "seg_id", F.lit("`\n\n"), "source", F.lit("\n\n> "), text, F.lit("\n")).alias("entry"))
