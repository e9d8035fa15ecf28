"""SimHash near-duplicates: pivot distance tables.

Fingerprints: 64 bits over the XXH64 hashes of all 4-word shingles of the whole text. Two fingerprints link when they
differ in at most 4 bits; a component is what links reach.

The pivot distance table holds a fingerprint's Hamming distances to many reference fingerprints. Everything about
pairs is decided from it:
  1. References. The first is a fixed well-mixed value; REFERENCES more are it with one pair of bits turned, so that
     the difference of a coordinate to the first tells how far a fingerprint is from the first within that pair (0, 1
     or 2). The rest are independent well-mixed values.
  2. Who meets. A fingerprint that differs in at most 4 bits changes at most 4 of these differences. Dealt to b groups,
     they therefore agree on some b - 4 whole groups: each fingerprint is listed under each choice of b - 4 groups, and
     only fingerprints of one list meet.
  3. A pair whose rows differ by more than 4 in any coordinate is discarded (triangle inequality).
  4. Survivors are verified bit by bit.

Skew: copies of a text share a fingerprint and are one row here, joined back at the end. A list longer than
LIST_LIMIT is not judged; its fingerprints go on to a finer cut (more groups, longer keys), where every pair of them
meets again. At the finest cut what a list holds agrees in about 21 of 32 differences. Within a list a search looks
only at the fingerprints whose first coordinate is within 4, and takes each fingerprint's unseen neighbours off at
once, so a dense list costs about its length.

Defined results: null, empty and word-free texts have fingerprint zero and link like any other. Fewer than four words
form one shingle. Repeated rows give repeated rows. Null ids never name a component unless it has no other id. An
empty table gives no rows. Very long texts are hashed piece by piece, without loss. Other columns, whatever their
names (component_id among them), are ignored by near_duplicates and kept by drop_near_copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped, settle, utf8
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
PIECE = 1 << 22  # bytes of a text that are held as words at a time
CUTS = (6, 8, 10, 12)  # groups of differences, coarse to fine
LIST_LIMIT = 8192
REFERENCES = 32  # references that turn a pair of bits of the first
OTHERS = 31  # independent references

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in lists; each list but the first starts with the last width - 1 words of the one before."""
    if len(text) <= PIECE:
        yield text.split()
        return
    at, kept = 0, []
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.start() if m else len(text)
        words = kept + text[at:end].split()
        at = end
        if len(words) < width and at < len(text):
            kept = words
            continue
        yield words
        kept = words[-(width - 1) :] if width > 1 else []


def shingle_hashes(text: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the width-word shingles of UTF-8 bytes, repeats included, in arrays of bounded size."""
    digest = xxhash.xxh64_intdigest
    for k, words in enumerate(_pieces(text.lower(), width)):  # bytes.lower() changes A-Z only
        if not words or (k and len(words) < width):  # nothing, or a tail without a new shingle
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        if len(words) < width:
            yield np.array([digest(line, SEED)], dtype=np.uint64)
        else:
            yield np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=False)], dtype=np.uint64)


def majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer; zero for none."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64)) if n else 0


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The SimHash of UTF-8 bytes, as a signed 64-bit integer."""
    return majority(shingle_hashes(text, width))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t) for t in utf8(batch.column("_fm_text"))]
        yield pa.RecordBatch.from_arrays([batch.column("_fm_id"), pa.array(values, pa.int64())], ["_fm_id", "_fm_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_fm_id, _fm_fp) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_fm_id"), F.col(text_col).alias("_fm_text")).mapInArrow(_fingerprints, f"_fm_id {kind}, _fm_fp long")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pivots() -> np.ndarray:
    """Reference fingerprints: one, then it with the bits k and k + 32 turned for each k, then independent ones."""
    own = _mixed(np.arange(1, OTHERS + 2))
    pair = np.uint64((1 << 32) + 1) << np.arange(REFERENCES, dtype=np.uint64)
    return np.concatenate([own[:1], own[0] ^ pair, own[1:]])


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, a row per fingerprint."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ pivots()[None, :]).astype(np.int8)


def _near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) link: discard by the table, verify the rest."""
    alive = np.arange(len(i))
    for part in (slice(REFERENCES, REFERENCES + 12), slice(REFERENCES + 12, None), slice(0, REFERENCES)):  # most pairs fall to the first coordinates
        gap = np.abs(table[i[alive], part] - table[j[alive], part]).max(axis=1, initial=0)
        alive = alive[gap <= RADIUS]
    close = np.bitwise_count(fps[i[alive]].view(np.uint64) ^ fps[j[alive]].view(np.uint64)) <= RADIUS
    return alive[close]


def _search(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one list."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int64)
    low, high = np.searchsorted(first, first - RADIUS), np.searchsorted(first, first + RADIUS, side="right")
    unseen, a, b = np.ones(len(fps), dtype=bool), [], []
    for start in range(len(fps)):
        if not unseen[start]:
            continue
        unseen[start], queue = False, [start]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(unseen[low[x] : high[x]]) + low[x]
            found = rest[_near(fps, table, np.full(len(rest), order[x]), order[rest])]
            if len(found):
                a.append(np.full(len(found), order[x]))
                b.append(order[found])
                queue += found.tolist()
                unseen[found] = False
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _judge(limit: int | None):
    """Over rows sorted by (choice, key): links between fingerprints, and with b null those of lists that are too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in grouped(batches, ["choice", "key"]):
            fps = rows.column("fp").to_numpy()
            sizes = np.diff(starts)
            a, b = [], []
            small = np.flatnonzero((sizes >= 2) & (sizes <= 16))
            if len(small):
                first, size = starts[:-1][small], sizes[small]
                member = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                table = np.zeros((len(fps), 1 + REFERENCES + OTHERS), dtype=np.int8)
                table[member] = distance_table(fps[member])
                ends = np.repeat(first + size, size)
                for step in range(1, int(size.max())):
                    i = member[member + step < ends]
                    hit = _near(fps, table, i, i + step)
                    a.append(fps[i[hit]])
                    b.append(fps[i[hit] + step])
            yield _rows(a, b)
            for g in np.flatnonzero(sizes > 16):
                own = fps[starts[g] : starts[g + 1]]
                if limit and len(own) > limit:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.nulls(len(own), pa.int64())], ["a", "b"])
                    continue
                i, j = _search(own, distance_table(own))
                yield _rows([own[i]], [own[j]])

    return run


def _rows(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])


def _listed(cut: int):
    """(fp, choice, key): a fingerprint's key for each choice of groups of differences that must agree."""
    edges = [REFERENCES * k // cut for k in range(cut + 1)]
    chosen = list(combinations(range(cut), cut - RADIUS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            table = distance_table(fps).astype(np.int64)
            far = (table[:, :1] - table[:, 1 : 1 + REFERENCES] + 2) // 2  # distance to the first reference, by pairs of bits
            groups = [(far[:, lo:hi] << (2 * np.arange(lo, hi))).sum(axis=1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            for c, own in enumerate(chosen):
                key = sum(groups[k] for k in own)
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(np.full(len(fps), c, dtype=np.int32)), pa.array(key, pa.int64())], ["fp", "choice", "key"])

    return run


def links(fps: DataFrame, limit: int = LIST_LIMIT, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Links (a, b) that span the components of the distinct fingerprints in column fp."""
    found, now = None, fps
    for n, cut in enumerate(cuts):
        last = n == len(cuts) - 1
        listed = now.select("fp").mapInArrow(_listed(cut), "fp long, choice int, key long")
        judged = settle(listed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_judge(None if last else limit), "a long, b long"), "links")
        pairs = judged.filter("b is not null").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        now = judged.filter("b is null").select(F.col("a").alias("fp")).distinct()
        if last or now.isEmpty():
            return found
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIST_LIMIT) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    rows = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = settle(rows.groupBy(F.col("_fm_fp").alias("fp")).agg(F.min("_fm_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), limit), "a", "b")
    named = settle(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    best = settle(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "component_id"), "least")
    named = named.join(best, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = settle(named, "components")
    discard(fps)
    return rows.join(named, F.col("_fm_fp") == F.col("fp")).select(
        F.col("_fm_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fm_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
