"""Term mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import fixed as X


def mentions(texts: DataFrame) -> DataFrame:
    """texts: (doc_id, ord, text). A row for each match: term, kind, text and its position (doc, ord, pattern, match)."""
    def found(pattern: str, group: int, kind: str, rank: int):
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        return F.transform(hits, lambda v, i: F.struct(v.alias("term"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("at")))

    every = F.concat(found(X.TERM_KATAKANA, 0, "katakana", 0), found(X.TERM_QUOTED, 1, "quoted", 1), found(X.TERM_KANJI, 0, "kanji", 2))
    rows = texts.filter("text is not null").select("doc_id", "ord", "text", F.explode(every).alias("m")).select("doc_id", "ord", "text", "m.*")
    stopped = ((F.col("kind") == "katakana") & F.col("term").isin(*X.STOP_KATAKANA)) | ((F.col("kind") == "kanji") & F.col("term").isin(*X.STOP_KANJI))
    return rows.filter(~stopped & ~F.col("term").rlike("^[ぁ-ゟー]+$"))


def candidates(texts: DataFrame, min_count: int = 3) -> DataFrame:
    """term, n, kind, sample: kind and sample are those of the first mention."""
    first = F.struct("doc_id", "ord", "rank", "at")
    out = mentions(texts).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min_by("kind", first).alias("kind"), F.min_by(F.substring("text", 1, 48), first).alias("sample"))
    return out.filter((F.col("n") >= min_count) & ~F.col("term").rlike(r"^\d+$"))


def top_terms(texts: DataFrame, min_count: int = 3, top: int = 400) -> DataFrame:
    """The report of the most frequent candidates."""
    return candidates(texts, min_count).orderBy(F.desc("n"), "term").limit(top)
