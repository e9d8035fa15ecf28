"""Glossary files: k=v lines, tab-separated lines (first and last filled cell), or a JSON object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines: (line_no, line). gl_order, term, expected; of a term's lines the last counts, at the first one's place."""
    line = F.trim("line", F.lit(" \t\r"))
    cells = F.transform(F.split("l", "\t"), lambda c: F.trim(c))
    filled = F.filter(F.slice(F.col("cells"), 2, 1_000), lambda c: c != "")
    at = F.instr("l", "=")
    tabbed = F.col("l").contains("\t")
    term = F.when(tabbed, F.get("cells", 0)).when(at > 0, F.trim(F.expr("substring(l, 1, instr(l, '=') - 1)")))
    expected = F.when(tabbed, F.try_element_at(F.col("filled"), F.lit(-1))).when(at > 0, F.trim(F.expr("substring(l, instr(l, '=') + 1)")))
    rows = lines.withColumn("l", line).filter("l <> '' and not startswith(l, '#')").withColumn("cells", cells).withColumn("filled", filled)
    rows = rows.select("line_no", term.alias("term"), expected.alias("expected"), (tabbed & (F.get("cells", 0) == "source")).alias("header"))
    rows = rows.filter("not header and term <> '' and expected <> ''")
    best = rows.groupBy("term").agg(F.min("line_no").alias("first"), F.max_by("expected", "line_no").alias("expected"))
    return best.select(F.row_number().over(W.orderBy("first")).alias("gl_order"), "term", "expected")


def parse_json(text: DataFrame) -> DataFrame:
    """text: (value). Entries of a JSON object with a value that is not blank."""
    pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e"))
    return pairs.filter(F.trim("e.value") != "").select((F.col("pos") + 1).alias("gl_order"), F.col("e.key").alias("term"), F.col("e.value").alias("expected"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A glossary file of either form. Glossaries are edited by hand and small; their lines are numbered in one task."""
    if path.lower().endswith(".json"):
        return parse_json(spark.read.text(path, wholetext=True))
    whole = spark.read.text(path, wholetext=True)
    return parse_lines(whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
