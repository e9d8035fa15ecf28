"""Language identification by rank-order profiles.

A profile ranks a language's most frequent character n-grams (n = 1 to 3, words padded with a space). A document's
most frequent n-grams are ranked likewise from its whole text and compared with every profile by the out-of-place
distance: the sum of rank differences, with the largest difference for an n-gram that the profile lacks.

An n-gram is an exact 63-bit integer (21 bits a code point), so counting is sorting and nothing collides. Long texts
are counted piece by piece. Profiles are fitted on a bounded sample: for each language at most SAMPLE documents, the
ones with the smallest hash in each of SAMPLE hash buckets. Predictions cover every row and read the whole text.

Defined results: null text or text without a letter is "und" with score 0. Rows with null lang are never learned from
and are predicted like any other. With nothing to learn from, every row is "und". Ties go to the language that sorts
first. A null id is held out. Repeated rows are predicted each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, settle

SAMPLE = 1000
TOP = 400
ORDERS = 3
PIECE = 1 << 20
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of non-letters as one space, a space at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    c = np.where(_letters()[c], c, 32)
    c = np.concatenate([[32], c, [32]])
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts."""
    grams, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # cut between words where there is a space near
            space = text.rfind(" ", at + PIECE // 2, end)
            end = space if space > 0 else end
        c = _codes(text[at:end])
        at = end
        parts = [c[c != 32]]
        for n in range(2, ORDERS + 1):
            if len(c) < n:
                break
            g = c[: len(c) - n + 1].copy()
            for k in range(1, n):
                g |= c[k : len(c) - n + 1 + k] << (21 * k)
            inner = np.zeros(len(g), dtype=bool)
            for k in range(n):
                inner |= c[k : len(c) - n + 1 + k] != 32
            middle = np.ones(len(g), dtype=bool)  # a space stands at an end only
            for k in range(1, n - 1):
                middle &= c[k : len(c) - n + 1 + k] != 32
            parts.append(g[inner & middle])
        own = np.sort(np.concatenate(parts))
        if not len(own):
            continue
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        u, k = own[first], np.diff(np.append(first, len(own)))
        if len(grams):
            both = np.concatenate([grams, u])
            grams, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, k]), minlength=len(grams)).astype(np.int64)
        else:
            grams, counts = u, k
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The top n-grams, most frequent first, ties by code."""
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:top]


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, text) of the documents to learn from: the smallest hash of each bucket, so at most sample per language."""
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), fold(id_col).alias("f"), F.xxhash64(id_col).alias("h"))
    own = own.filter("f <> 0 and lang is not null and id is not null")
    chosen = own.groupBy("lang", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min(F.struct("h", "id")).alias("best"))
    chosen = chosen.select(F.col("lang").alias("c_lang"), F.col("best.id").alias("c_id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # at most sample rows a language: bounded by the parameter, whatever the table's size
    return texts.join(F.broadcast(chosen), (F.col("id") == F.col("c_id")) & (F.col("lang") == F.col("c_lang"))).select("lang", "text")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(gram_counts(text or ""))
        for lang, parts in held.items():
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def fit_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, top: int = TOP) -> dict[str, np.ndarray]:
    """Each language's n-grams in rank order."""
    counts = _sampled(docs, id_col, text_col, lang_col, sample).mapInArrow(_count_batches, "lang string, gram long, n long")
    counts = settle(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    best = lambda x: counts.filter(F.col("lang") == x).orderBy(F.desc("n"), "gram").limit(top).collect()
    return {x: np.array([r.gram for r in best(x)], dtype=np.int64) for x in langs}


def out_of_place(order: np.ndarray, profile: np.ndarray, top: int = TOP) -> float:
    """Mean rank difference between a document's n-grams and a profile, as a share of the largest (0 to 1)."""
    if not len(order):
        return 1.0
    by = np.argsort(profile)
    names = profile[by]
    at = np.searchsorted(names, order)
    at[at == len(names)] = 0
    here = names[at] == order if len(names) else np.zeros(len(order), dtype=bool)
    gap = np.where(here, np.abs(by[at] - np.arange(len(order))), top) if len(names) else np.full(len(order), top)
    return float(np.minimum(gap, top).mean() / top)


class _Profiles:
    """All profiles as one sorted table: n-gram to its rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        names = [profiles[x] for x in self.langs]
        self.grams = np.unique(np.concatenate(names)) if names else np.zeros(0, dtype=np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, own in enumerate(names):
            self.ranks[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        order = ranked(*gram_counts(text or ""), self.top)
        if not len(order) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, order)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != order)] = len(self.grams)
        ranks = self.ranks[at]
        gap = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(order))[:, None]), self.top), self.top)
        distance = gap.mean(axis=0) / self.top
        k = int(distance.argmin())
        return self.langs[k], float(1.0 - distance[k])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """id, held_out, lang_pred, score for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Profiles(profiles, top)
        for batch in batches:
            found = [table.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [id_col, "held_out", "lang_pred", "score"],
            )

    own = docs.select(F.col(id_col).alias("id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn profiles from the rows outside fold 0, then predict every row."""
    return predict(docs, fit_profiles(docs, id_col, text_col, lang_col), id_col, text_col)
