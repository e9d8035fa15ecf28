"""Comparison of an extraction with a reference text, paragraph by paragraph, and character profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Lengths of texts that are compared in one task; cells of a block of character counts.
RANGE, BLOCK = 512, 1 << 22


def overlap(a: DataFrame, b: DataFrame, col: str = "text") -> DataFrame:
    """One row: distinct paragraphs of both, common ones, only in a, only in b, precision and coverage."""
    sides = a.select(col, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(col, F.lit(0).alias("l"), F.lit(1).alias("r")))
    s = sides.groupBy(col).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    both = F.sum(F.col("l") * F.col("r"))
    out = s.agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"), both.alias("common"))
    return out.select(
        "left_n", "right_n", "common", (F.col("left_n") - F.col("common")).alias("left_only"), (F.col("right_n") - F.col("common")).alias("right_only"),
        F.round(F.try_divide("common", "left_n"), 6).alias("precision"), F.round(F.try_divide("common", "right_n"), 6).alias("coverage"),
    )


def fragments(parts: DataFrame, wholes: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Paragraphs of parts that stand inside a longer paragraph of wholes with the same key."""
    w = wholes.select(*[F.col(k).alias(f"w_{k}") for k in key], F.col(text).alias("w_text"))
    cond = F.col("w_text").contains(F.col(text)) & (F.length("w_text") > F.length(text))
    for k in key:
        cond = cond & (F.col(k) == F.col(f"w_{k}"))
    return parts.join(w, cond, "left_semi")


def exact_hits(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """One row: paragraphs of a with their repeats, those that stand in b character by character, and their share."""
    known = b.select(text).distinct().withColumn("hit", F.lit(1))
    out = a.join(known, text, "left").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return out.withColumn("share", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 6))


def short_parts(rows: DataFrame, most: int = 8, top: int = 12, text: str = "text") -> DataFrame:
    """kind, text, n: how many texts are short (of `most` characters or fewer), and the most frequent of one to three Latin letters or digits."""
    by = rows.filter(F.length(text) <= most).groupBy(text).agg(F.count(F.lit(1)).alias("n"))
    short = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("short").alias("kind"), F.lit(None).cast("string").alias("text"), "n")
    latin = by.filter(F.col(text).rlike("^[0-9A-Za-z\uff10-\uff19]{1,3}$")).orderBy(F.desc("n"), text).limit(top)
    return short.unionByName(latin.select(F.lit("latin").alias("kind"), F.col(text).alias("text"), "n"))


def char_tokens(text: Column) -> Column:
    """A string as a set of numbers, one for each character and its how-manieth; shared ones are the shared characters."""

    def numbered(chars: Column) -> Column:
        count = lambda c: F.size(F.filter(chars, lambda x: x == c))
        return F.flatten(F.transform(F.array_distinct(chars), lambda c: F.transform(F.sequence(F.lit(1), count(c)), lambda n: c * (1 << 32) + n)))

    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.get(F.transform(F.array(codes), numbered), 0)  # bound once, not split again for each character


def _likeness(a_chars: Column, b_chars: Column, n: Column) -> Column:
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a_chars, b_chars)) / n)


def quick_ratio(a: Column, b: Column) -> Column:
    """Twice the shared characters over all characters; 1 for two empty strings."""
    return _likeness(char_tokens(a), char_tokens(b), F.length(a) + F.length(b))


def nearest(a: DataFrame, b: DataFrame, key: str, band: int = 40) -> DataFrame:
    """For each row of a the most similar row of b with the same key whose length differs by at most band.

    Likeness is twice the shared characters over all characters, 1 for two empty strings; of equals the smallest id counts.
    Rows are dealt by key and range of length, and a row of b goes to the next range too where that is within the band.
    Each text travels about once, and pairs are made and scored in the task that holds their range, block by block: no pair
    is written, and a task holds the texts of one range of one key.
    """
    both, n = a is b, F.length("text")
    cell = F.floor(n / RANGE)
    known = lambda df: df.filter(F.col(key).isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    near = F.sequence(F.floor(F.greatest(n - band, F.lit(0)) / RANGE), F.floor((n + band) / RANGE))
    right = known(b).select(key, "id", "text", n.alias("n"), cell.alias("own"), F.explode(near).alias("cell"))
    rows = right.select(key, "cell", "n", "id", "text", (F.lit(both) & (F.col("cell") == F.col("own"))).alias("left"), F.lit(True).alias("right"))
    if not both:
        rows = rows.unionByName(known(a).select(key, cell.alias("cell"), n.alias("n"), "id", "text", F.lit(True).alias("left"), F.lit(False).alias("right")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.repartition(key, "cell").sortWithinPartitions(key, "cell", "n")
    j = dealt.mapInArrow(_nearest_batches(key, band), f"`{key}` {kinds[key]}, a_id {kinds['id']}, b_id {kinds['id']}, score double")
    best = j.groupBy(key, "a_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "b_id")).alias("best"))  # of repeated rows one is kept
    return best.select(key, "a_id", "best.b_id", (-F.col("best.minus")).alias("score"))


def _nearest_batches(key: str, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, [key, "cell"]):
            at, other, millionths = _nearest_in(group, band)
            ids = group.column("id")
            yield pa.RecordBatch.from_arrays([group.column(key).take(at), ids.take(at), ids.take(other), pa.array(millionths / 1e6, pa.float64())], [key, "a_id", "b_id", "score"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Cut a stream that is sorted by key columns at key changes; a group that spans batches is carried over."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _nearest_in(group: pa.RecordBatch, band: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Rows of a group sorted by n: places of the left rows that have a match, of their matches, and the score in millionths."""
    n = group.column("n").to_numpy().astype(np.int64)
    left = np.flatnonzero(group.column("left").to_numpy(zero_copy_only=False))
    right = group.column("right").to_numpy(zero_copy_only=False)
    none = pa.array([], pa.int64()), pa.array([], pa.int64()), np.empty(0)
    if not len(left) or len(n) < 2:
        return none
    ids = group.column("id").to_pylist()
    place = {x: k for k, x in enumerate(sorted(set(ids)))}
    rank = np.fromiter((place[x] for x in ids), np.int64, len(ids))
    text = group.column("text").to_pylist()
    codes, where = np.unique(np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in text])])
    wide, kind = max(len(codes), 1), np.uint16 if n[-1] < 1 << 16 else np.uint32
    step = max(1, BLOCK // wide)  # rows of a block of counts

    def counts(lo: int, hi: int) -> np.ndarray:
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        return np.bincount(row * wide + where[ends[lo] : ends[hi]], minlength=(hi - lo) * wide).reshape(hi - lo, wide).astype(kind)

    lows, highs = np.searchsorted(n, n - band), np.searchsorted(n, n + band, "right")
    best, match = np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64)
    for q in range(0, len(n), step):
        mine = left[(left >= q) & (left < q + step)]
        if not len(mine):
            continue
        own = counts(q, min(q + step, len(n)))
        for c in range(int(lows[mine[0]]) // step * step, int(highs[mine[-1]]), step):
            theirs = own if c == q else counts(c, min(c + step, len(n)))
            for i in mine:
                lo, hi = max(int(lows[i]), c), min(int(highs[i]), c + step)
                if lo >= hi:
                    continue
                shared = np.minimum(theirs[lo - c : hi - c], own[i - q]).sum(axis=1, dtype=np.int64)
                total = n[lo:hi] + n[i]
                # 2 shared / total, rounded half up to millionths; whole numbers, so that equal ones are equal
                score = np.where(total == 0, 1_000_000, (4_000_000 * shared + total) // np.maximum(2 * total, 1))
                score[~right[lo:hi] | (rank[lo:hi] == rank[i])] = -1
                top = int(score.max())
                if top < 0 or top < best[i]:
                    continue
                ties = lo + np.flatnonzero(score == top)
                first = int(ties[np.argmin(rank[ties])])
                if top > best[i] or rank[first] < rank[match[i]]:
                    best[i], match[i] = top, first
    found = left[best[left] >= 0]
    return pa.array(found), pa.array(match[found]), best[found]


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks as a share of all characters; there is no built-in for it."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def char_profile(text: Column) -> Column:
    """Struct of kana, kanji, ASCII and all characters."""
    count = lambda p: F.length(F.regexp_replace(text, f"[^{p}]", ""))
    return F.struct(count("ぁ-ゟァ-ヶ").alias("kana"), count("一-鿿").alias("kanji"), count("\\x21-\\x7e").alias("ascii"), F.length(text).alias("chars"))


def residual_class(a: Column, b: Column) -> Column:
    """Why two near-equal paragraphs differ."""
    squeeze = lambda c: F.regexp_replace(c, "\\s+", "")
    bare = lambda c: F.regexp_replace(squeeze(c), r"\p{Punct}", "")
    return F.when(a == b, "equal").when(squeeze(a) == squeeze(b), "space").when(bare(a) == bare(b), "punctuation").when(F.lower(bare(a)) == F.lower(bare(b)), "case").otherwise("text")
