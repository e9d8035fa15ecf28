"""The stages of a book's way, as functions over tables that hold many books at once.

Every stage takes and returns DataFrames, so stages compose, and a caller writes between them what it wants to keep.
Resuming is an anti-join with what is there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import text as t
from foliomill.operators import provider as pv
from foliomill.operators import quality, render, sequence
from foliomill.operators import segments as seg


def import_blocks(blocks: DataFrame, old: DataFrame | None = None, memory: DataFrame | None = None, skip_matter: tuple[str, ...] = ()) -> DataFrame:
    """The segment table of blocks: seg_id, doc_id, block_id, ord, text, text_hash, source_lang, status, translation, final.

    old: the table before; unchanged rows keep what they have. memory: translations that pending rows take over.
    blocks: doc_id, block_id, ord, type, text, matter, source_lang.
    """
    units = blocks.filter(F.col("type").isin("heading", "paragraph", "footnote") & ~t.is_blank("text") & ~F.col("matter").isin(*skip_matter))
    new = units.select(F.concat_ws(":", F.col("doc_id").cast("string"), "block_id").alias("seg_id"), "doc_id", "block_id", "ord", "text", t.text_hash("text").alias("text_hash"), F.coalesce("source_lang", F.lit("")).alias("source_lang"))
    if old is None:
        out = new.withColumns({"status": F.lit("pending"), "translation": F.lit(None).cast("string"), "final": F.lit(None).cast("string")})
    else:
        state = seg.upsert(old, new).filter("not orphan").select("seg_id", "status", "translation", "final")
        out = new.join(state, "seg_id")
    if memory is None:
        return out
    m = memory.select("text_hash", F.coalesce("source_lang", F.lit("")).alias("source_lang"), F.col("translation").alias("known"))
    take = (F.col("status") == "pending") & F.col("known").isNotNull()
    j = out.join(m, ["text_hash", "source_lang"], "left")
    return j.withColumn("translation", F.when(take, F.col("known")).otherwise(F.col("translation"))).withColumn("status", F.when(take, "done").otherwise(F.col("status"))).drop("known")


def translate(segments: DataFrame, provider: pv.Provider, max_chars: int = 2400, max_items: int = 24, rounds: int = 3) -> DataFrame:
    """Pending and failed segments through the provider, in batches that keep a document's order."""
    todo = segments.filter(F.col("status").isin("pending", "failed"))
    batches = sequence.batches(todo.select("doc_id", "ord", F.length("text").alias("n")), max_chars, max_items)
    items = todo.join(batches, ["doc_id", "ord"]).select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("batch").cast("string")).alias("batch"), "seg_id", "text")
    results = pv.repair(items, provider, rounds).select("seg_id", F.col("translation").alias("got"), "error")
    j = segments.join(results, "seg_id", "left")
    ok = F.col("got").isNotNull() & F.col("error").isNull()
    return j.withColumn("translation", F.when(ok, F.col("got")).otherwise(F.col("translation"))).withColumn("status", F.when(ok, "done").when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))).drop("got", "error")


def check(segments: DataFrame, glossary: list[tuple[str, str]] = ()) -> DataFrame:
    """The quality issues of the effective texts."""
    pairs = segments.select("seg_id", F.col("text").alias("source"), t.effective_text("final", "translation").alias("target"), "status")
    return quality.issues(pairs, glossary)


def render_books(blocks: DataFrame, segments: DataFrame, mode: str = "bilingual") -> DataFrame:
    """The chapters of every book."""
    return render.chapters(blocks, segments.select("doc_id", "block_id", t.effective_text("final", "translation").alias("tgt")), mode)
