"""Units, segments, the translation memory and upserts as table-to-table transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliomill.functions import text as t


def units(blocks: DataFrame) -> DataFrame:
    """Translation units: a block, or a table's cells in row order; ord counts blank units too."""
    plain = blocks.filter("type in ('heading', 'paragraph', 'footnote')").select("doc_id", "ord", F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("block_id").alias("unit_id"), "text", F.col("type").alias("kind"))
    rows = blocks.filter("type = 'table'").select("doc_id", "ord", "block_id", F.posexplode("rows").alias("r", "row"))
    cells = rows.select("doc_id", "ord", "block_id", "r", F.posexplode("row").alias("c", "text"))
    cells = cells.select("doc_id", "ord", "r", "c", F.format_string("%s:r%dc%d", "block_id", "r", "c").alias("unit_id"), "text", F.lit("cell").alias("kind"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("ord", "r", "c"))
    return plain.unionByName(cells).withColumn("unit_ord", n).filter(F.trim("text") != "").select("doc_id", "unit_id", "unit_ord", "kind", "text")


def carry_over(segments: DataFrame, memory: DataFrame, target_lang: str = "zh") -> DataFrame:
    """Pending segments that the memory of a target language knows, with its translation.

    A segment without a language meets nothing, as in any join; an empty language meets an empty one. Segments without a
    status column are all pending. Hash and language are the memory's key, so no segment comes twice.
    """
    s = segments.filter("status = 'pending'") if "status" in segments.columns else segments
    m = memory.filter(F.col("target_lang") == target_lang).select("text_hash", "source_lang", "translation")
    return s.drop("translation").join(m, ["text_hash", "source_lang"])


def memory_of(segments: DataFrame, target_lang: str = "zh") -> DataFrame:
    """One memory entry for each (hash, language); the translation is the last by order. A null language is kept as empty."""
    key = ["text_hash", F.coalesce("source_lang", F.lit("")).alias("source_lang")]
    return segments.groupBy(*key).agg(F.max_by("translation", F.struct("doc_id", "ord")).alias("translation")).withColumn("target_lang", F.lit(target_lang))


def reimport(old: DataFrame, new: DataFrame) -> DataFrame:
    """seg_id, change: created, updated, unchanged or orphan; texts are compared by normalised hash."""
    a, b = old.select("seg_id", F.col("text_hash").alias("was")), new.select("seg_id", F.col("text_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "orphan").when(F.col("was") != F.col("now"), "updated").otherwise("unchanged")
    return a.join(b, "seg_id", "full_outer").select("seg_id", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The segment table after an import: new rows are pending, changed rows lose their translation, orphans stay."""
    o = old.select("seg_id", *[F.col(c).alias(f"o_{c}") for c in ("text", "text_hash", "status", "translation", "final")])
    j = o.join(new.select("seg_id", "text", "text_hash"), "seg_id", "full_outer")
    reset = F.col("o_text_hash").isNull() | (F.col("text_hash") != F.col("o_text_hash"))
    orphan = F.col("text_hash").isNull()
    keep = lambda c, value: F.when(orphan, F.col(f"o_{c}")).when(reset, value).otherwise(F.col(f"o_{c}")).alias(c)
    return j.select("seg_id", F.coalesce("text", "o_text").alias("text"), F.coalesce("text_hash", "o_text_hash").alias("text_hash"), keep("status", F.lit("pending")), keep("translation", F.lit(None)), keep("final", F.lit(None)), orphan.alias("orphan"))


def record(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Apply results (seg_id, translation, error): done or failed, one more attempt; the reviewed text is untouched."""
    r = results.select("seg_id", F.col("translation").alias("r_translation"), F.col("error").alias("r_error"), F.lit(True).alias("hit"))
    j = segments.join(r, "seg_id", "left")
    ok = F.col("hit") & F.col("r_error").isNull()
    return j.select(
        "seg_id",
        F.when(ok, F.col("r_translation")).otherwise(F.col("translation")).alias("translation"),
        "final",
        F.when(ok, "done").when(F.col("hit"), "failed").otherwise(F.col("status")).alias("status"),
        (F.col("attempts") + F.coalesce(F.col("hit").cast("int"), F.lit(0))).alias("attempts"),
        F.when(F.col("hit"), F.substring("r_error", 1, 500)).otherwise(F.col("last_error")).alias("last_error"),
    )


def mismatches(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Translatable blocks that no segment stands for."""
    return blocks.join(segments, ["doc_id", "block_id"], "left_anti").select("doc_id", "block_id")


def search(segments: DataFrame, q: str | None = None, status: str | None = None, columns: tuple[str, ...] = ("text",), literal: bool = False) -> DataFrame:
    """Rows of a status whose columns contain q, in any case; % and _ in q are wildcards unless literal."""
    out = segments.filter(F.col("status") == status) if status else segments
    if q:
        pattern = "%" + (q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else q) + "%"
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
        out = out.filter(hit)
    return out


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page in order; the limit is held between 1 and 1000."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(key).orderBy(F.desc(seq))
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def duplicates(segments: DataFrame) -> DataFrame:
    """Content that occurs more than once: hash, number of segments and of documents, first segment."""
    return segments.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("seg_id").alias("first_seg")).filter("n > 1")


def effective(rows: DataFrame) -> DataFrame:
    return rows.withColumn("effective", t.effective_text("final", "translation"))
