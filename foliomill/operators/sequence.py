"""Chapters, batches and context windows: ordered operators within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliomill.functions import fixed as X
from foliomill.functions import text as t

FRONT = "（前言）"


def running():
    """A document's rows up to the current one."""
    return W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)


def chapters(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, block_id, text, chapter, title of the blocks that chapters hold.

    A story heading of the top level opens a chapter; other top headings are dropped; blocks before the first are
    chapter 0. blocks: with level, matter and translatable.
    """
    top = F.coalesce(F.min(F.when(F.col("type") == "heading", F.coalesce("level", F.lit(1)))).over(W.partitionBy("doc_id")), F.lit(1))
    is_top = (F.col("type") == "heading") & (F.coalesce("level", F.lit(1)) <= F.col("top")) & (F.trim("text") != "")
    story = F.col("matter").isin(*X.STORY_MATTER)
    rows = blocks.withColumn("top", top).withColumn("is_top", is_top).withColumn("opens", F.col("is_top") & story)
    rows = rows.withColumn("chapter", F.sum(F.col("opens").cast("int")).over(running()))
    rows = rows.filter(F.col("opens") | (~F.col("is_top") & F.col("translatable") & story))
    title = F.first(F.when(F.col("opens"), F.trim("text")), ignorenulls=True).over(W.partitionBy("doc_id", "chapter"))
    return rows.withColumn("title", F.when(F.col("chapter") == 0, FRONT).otherwise(title)).select("doc_id", "ord", "block_id", "text", "chapter", "title")


def chapter_texts(rows: DataFrame, limit: int) -> DataFrame:
    """doc_id, chapter, title, blocks and the first characters of the joined text."""
    texts = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("ord", "text"))))
    joined = F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), 1, limit)
    return rows.groupBy("doc_id", "chapter", "title").agg(F.count(F.lit(1)).alias("blocks"), texts.alias("parts")).select("doc_id", "chapter", "title", "blocks", joined.alias("text"))


def render_chapters(blocks: DataFrame) -> DataFrame:
    """The other chapter rule, for output: every heading opens one; an empty leading part is dropped."""
    return blocks.withColumn("part", F.sum((F.col("type") == "heading").cast("int")).over(running()))


def batches(items: DataFrame, max_chars: int = 2400, max_items: int = 24) -> DataFrame:
    """doc_id, ord, batch: consecutive items, closed when characters or items would go over; a fold over a document.

    items: (doc_id, ord, n). The state is the open batch and what it holds; a document's items are one array.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("count"), F.array().cast("array<struct<ord:int,batch:int>>").alias("out"))

    def step(s, x):
        full = (s["count"] > 0) & ((s["used"] + x["n"] > max_chars) | (s["count"] >= max_items))
        batch = s["batch"] + full.cast("int")
        return F.struct(batch.alias("batch"), F.when(full, x["n"]).otherwise(s["used"] + x["n"]).alias("used"), F.when(full, F.lit(1)).otherwise(s["count"] + 1).alias("count"), F.concat(s["out"], F.array(F.struct(x["ord"].alias("ord"), batch.alias("batch")))).alias("out"))

    xs = F.array_sort(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), F.col("n").cast("long").alias("n"))))
    folded = items.groupBy("doc_id").agg(xs.alias("xs")).select("doc_id", F.aggregate("xs", start, step, lambda s: s["out"]).alias("out"))
    return folded.select("doc_id", F.explode("out").alias("o")).select("doc_id", "o.ord", "o.batch")


def previous_context(summaries: DataFrame, window: int = 4) -> DataFrame:
    """doc_id, chapter, context: the last summaries before a chapter, in order."""
    w = W.partitionBy("doc_id").orderBy("chapter").rowsBetween(-window, -1)
    return summaries.select("doc_id", "chapter", F.array_join(F.collect_list("summary").over(w), "\n").alias("context"))


def context_for(requests: DataFrame, summaries: DataFrame, window: int = 4) -> DataFrame:
    """The same for chapters that have no summary of their own: a range join, then the last few."""
    s = summaries.select(F.col("doc_id").alias("s_doc"), F.col("chapter").alias("s_chapter"), "summary")
    j = requests.join(s, (F.col("doc_id") == F.col("s_doc")) & (F.col("s_chapter") < F.col("chapter")))
    near = j.withColumn("rn", F.row_number().over(W.partitionBy("doc_id", "chapter").orderBy(F.desc("s_chapter")))).filter(F.col("rn") <= window)
    return near.groupBy("doc_id", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_chapter", "summary"))), lambda p: p["summary"]), "\n").alias("context"))


def cost_guard(costs: DataFrame, most: float) -> DataFrame:
    """Batches that start before the accumulated cost reaches the limit. costs: (doc_id, batch, cost)."""
    before = F.coalesce(F.sum("cost").over(W.partitionBy("doc_id").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return costs.withColumn("spent_before", F.round(before, 10)).filter(F.col("spent_before") < most)


def pick_cover(images: DataFrame) -> DataFrame:
    """doc_id, path: the first image marked as cover, else the first with a telling file name."""
    rank = F.when(F.col("matter") == "cover", 0).when(F.element_at(F.split("path", "/"), -1).rlike("(?i)" + "|".join(X.COVER_NAMES)), 1)
    return images.withColumn("rank", rank).filter("rank is not null").groupBy("doc_id").agg(F.min_by("path", F.struct("rank", "ord")).alias("path"))


def prune(summaries: DataFrame, keep: DataFrame) -> DataFrame:
    """Summaries of the chapters that are kept; an empty keep set deletes all."""
    return summaries.join(keep, ["doc_id", "chapter"], "left_semi")


def estimate(texts: DataFrame, price_in: float, price_out: float, contexts: DataFrame | None = None, overhead: float = 1.4, answer: float = 0.7) -> DataFrame:
    """One row: tokens in and out and the cost of a run over texts; contexts (text) are what each batch repeats, and count once a batch."""
    own = texts.agg(F.floor(F.coalesce(F.sum(t.estimate_tokens("text")), F.lit(0)) * overhead).alias("n"))
    if contexts is not None:
        own = own.unionByName(contexts.filter("text <> ''").agg(F.coalesce(F.sum(t.estimate_tokens("text")), F.lit(0)).alias("n")))
    total = own.agg(F.sum("n").alias("tokens_in")).withColumn("tokens_out", F.floor(F.col("tokens_in") * answer))
    return total.withColumn("cost", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 8))
