"""Suffix-array deduplication of long repeated byte strings, built by linear grouping.

Every byte covered by a WINDOW-byte string that also starts anywhere else (in the same or another document) is
removed; all strings are judged on the input.

Meeting places. Each window of WINDOW bytes is owned by its anchor: the GRAM-byte string inside it with the smallest
hash, leftmost on ties. Equal windows have equal anchors at equal offsets, so they can only meet in the group of one
anchor hash. The windows of an anchor form one stretch of the document, its context; a text has about one context per
WINDOW / 2 bytes.
  1. Anchor hashes that occur once are dropped.
  2. Contexts that are equal as a whole (128 bits of BLAKE2b, beside the anchor hash) are repeats: all their bytes go,
     in every document that has them. From here on each distinct context counts once.
  3. Groups with several distinct contexts are judged by suffix order. Contexts are lined up at their anchor and cut at
     every column where two of them begin or cease to agree; equal blocks between cuts get equal symbols. The suffix
     array of these symbol strings, with common prefixes measured in bytes, gives the longest repeat from each cut.
  4. Groups with more than GROUP_LIMIT distinct contexts, which one task must not hold, are judged by ranges of window
     offsets, coarse to fine, from 128-bit digests that are counted with partial aggregation. This is exact as well.

The suffix array is made by linear grouping (suffix_array): suffixes are grouped by first symbol; groups are taken in
descending order, every member finds its previous smaller suffix by pointer jumping, and the suffixes pointed at move
to new groups behind their old ones, by how often they were pointed at. Then groups equal Lyndon prefixes, and one
ascending pass emits each group's order along the same pointers, without recursion or renaming.

Rows are identified by (id, hash of the text), so repeated rows count as copies of each other and share one set of spans. Text moves twice: to cut
out contexts of groups with several, and to apply the spans at the end.

Defined results: null counts as empty. Texts shorter than a window lose nothing. Very long texts are read in overlapping
pieces of SEGMENT bytes, which changes no result. Columns other than id and text, whatever their names, are ignored. Null ids are judged like any other.
Repeated rows of at least a window's length lose everything. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, grouped, release, settle

WINDOW = 400
GRAM = 48
SEGMENT = 1 << 21  # bytes that are hashed at a time
GROUP_LIMIT = 256
LEVELS = (32, 8, 1)  # window offsets in a range, where a group is too large for one task
SYMBOLS = 100_000  # symbols that are sorted at a time
NO_ID = -(2**63)
CONTEXT = ["cx", "cy"]  # 128 bits of a context's digest
FULL = ["full", "full2"]  # likewise of a range's bytes

_BITS = 24
_MASK = np.uint64((1 << _BITS) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


# --- linear grouping -------------------------------------------------------------------------------------------------


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Positions of all suffixes in ascending order, by linear grouping."""
    s = np.append(np.asarray(symbols, dtype=np.int64) + 1 - min(symbols, default=0), 0)  # an end mark below all others
    n = len(s)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    starts = np.repeat(first, np.diff(np.append(first, n)))
    slot = np.empty(n, dtype=np.int64)
    slot[order] = np.arange(n)
    lane, where = order.tolist(), slot.tolist()  # suffixes by group, and each suffix's place there
    group = starts[slot].tolist()  # a group is named by its first place, so names compare like groups
    size = dict(zip(first.tolist(), np.diff(np.append(first, n)).tolist(), strict=True))
    before = [-1] * n  # the previous suffix in a smaller group

    top = n
    while top > 0:
        g = group[lane[top - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(lane[g:top]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        top = g
        by_times: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_times.setdefault(times, []).append(j)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}  # old group: how many leave it
            for j in by_times[times]:
                old = group[j]
                gone = moved.get(old, 0) + 1
                moved[old] = gone
                at = old + size[old] - gone
                other, here = lane[at], where[j]
                lane[at], lane[here] = j, other
                where[j], where[other] = at, here
            names = {}
            for old, gone in moved.items():
                if left := size[old] - gone:  # a group that all members leave keeps its name, its first place
                    size[old], size[old + left], names[old] = left, gone, old + left
            for j in by_times[times]:
                group[j] = names.get(group[j], group[j])

    out, front, done = [0] * n, {}, [False] * n
    out[0], done[n - 1] = n - 1, True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = front.get(g, g)
            out[at], done[j] = j, True
            front[g] = at + 1
            j = before[j]
    return out[1:]


def longest_repeats(symbols: Sequence[int], widths: Sequence[int]) -> list[int]:
    """For each position the bytes of its longest repeat elsewhere; widths are the bytes of the symbols."""
    n = len(symbols)
    sa = suffix_array(symbols)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    place = [0, *np.cumsum(widths).tolist()]
    best, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = sa[r - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        best[i] = max(best[i], place[i + h] - place[i])
        best[j] = max(best[j], place[j + h] - place[j])
        h = h - 1 if h else 0
    return best


# --- anchors and contexts --------------------------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd multiplier and of its inverse, mod 2**64."""
    if n not in _tables:
        _tables.clear()
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        up = np.full(n, _MULTIPLIER, dtype=np.uint64)
        down = np.full(n, pow(_MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _tables[n] = x ^ (x >> np.uint64(33)), np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[n]


def anchor_runs(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, first, last, anchor, hash): stretches of window starts with one anchor.

    buf: bytes, shorter than 2**24. Stretch k of valid window starts is lo[k] to hi[k], included; owner is k.
    """
    n, width = len(buf), WINDOW - GRAM + 1
    values, up, down = _powers(SEGMENT + 2 * WINDOW)
    if n > len(up):
        raise ValueError("segment too long")
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[buf] * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    key = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // width)
    blocks = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - width + 1  # windows
    anchor = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _MASK).astype(np.int64)
    new = np.zeros(count + 1, dtype=bool)
    new[1:count] = anchor[1:] != anchor[:-1]
    inside = np.zeros(count + 1, dtype=np.int64)
    np.add.at(inside, lo, 1)
    np.add.at(inside, np.minimum(hi + 1, count), -1)
    new[lo] = True
    first = np.flatnonzero(new[:count] & (np.cumsum(inside[:count]) > 0))
    owner = np.searchsorted(lo, first, side="right") - 1
    last = np.minimum(np.append(first[1:] - 1, count - 1), hi[owner])
    return owner, first, last, anchor[first], h[anchor[first]]


def _segments(offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(from, to, [(text, first window, last window)]): pieces of a buffer of texts, with positions in the buffer."""
    texts = [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) if b - a >= WINDOW]
    held: list[tuple[int, int, int]] = []
    for k, a, b in texts:
        if held and b - held[0][1] > SEGMENT:
            yield held[0][1], held[-1][2] + WINDOW, held
            held = []
        while b - a > SEGMENT:  # a long text: windows are dealt to pieces that overlap by a window
            yield a, a + SEGMENT, [(k, a, a + SEGMENT - WINDOW)]
            a += SEGMENT - WINDOW + 1
        if b - a >= WINDOW:
            held.append((k, a, b - WINDOW))
    if held:
        yield held[0][1], held[-1][2] + WINDOW, held


def _pack(start: np.ndarray, to_anchor: np.ndarray, to_last: np.ndarray) -> np.ndarray:
    """A context's first byte, its anchor's and its last window's distance from there, in one integer."""
    return (start << 20) | (to_anchor << 10) | to_last


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("body").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        if data is None or not len(texts):
            continue
        whole = np.frombuffer(data, dtype=np.uint8)
        did, tx = batch.column("did").to_numpy(), batch.column("tx").to_numpy()
        for lo, hi, parts in _segments(offsets):
            buf = whole[lo:hi]
            k, first, last = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
            owner, a, b, at, h = anchor_runs(buf, first - lo, last - lo)
            view = memoryview(buf)
            cx = [hashlib.blake2b(view[x : y + WINDOW], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            cx = np.frombuffer(b"".join(cx), dtype="<i8").reshape(-1, 2)
            row = k[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(cx[:, 0].copy()),
                    pa.array(cx[:, 1].copy()),
                    pa.array(did[row]),
                    pa.array(tx[row]),
                    pa.array(_pack(a + lo - offsets[row], at - a, b - a)),
                ],
                ["h", *CONTEXT, "did", "tx", "pos"],
            )


# --- groups of contexts ----------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, dtype=np.uint8, count=n), np.frombuffer(b, dtype=np.uint8, count=n)
    return int((x != y).argmax())


def _agreements(parts: list[bytes]) -> tuple[list[int], set[int]]:
    """For each string its longest common prefix with any other, and the set of all lengths at which two part."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    most, cuts = [0] * len(parts), set()
    for i, j in zip(order, order[1:], strict=False):
        n = _common(parts[i], parts[j])
        most[i], most[j] = max(most[i], n), max(most[j], n)
        cuts.add(n)
    return most, cuts


class _Sorter:
    """Symbol strings of many groups, sorted together."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.symbols, self.widths, self.places, self.names = [], [], [], {}
        self.ends = 0

    def add(self, group: int, contexts: list[tuple[int, bytes, int]]) -> None:
        """contexts: (row, bytes, anchor). Blocks are named by group, column and bytes."""
        left_most, left_cuts = _agreements([c[:a][::-1] for _, c, a in contexts])
        right_most, right_cuts = _agreements([c[a:] for _, c, a in contexts])
        alive = [k for k in range(len(contexts)) if left_most[k] + right_most[k] >= WINDOW]
        if not alive:
            return
        cuts = sorted({-x for x in left_cuts} | right_cuts | {0})
        for k in alive:
            row, c, a = contexts[k]
            own = [x for x in cuts if -left_most[k] <= x <= right_most[k]]
            for x, y in zip(own, own[1:], strict=False):
                self.symbols.append(self.names.setdefault((group, x, c[a + x : a + y]), len(self.names) + 1))
                self.widths.append(y - x)
                self.places.append((row, a + x))
            self.ends += 1
            self.symbols.append(-self.ends)  # no two ends are equal
            self.widths.append(0)
            self.places.append(None)

    def repeats(self) -> Iterator[tuple[int, int, int]]:
        """(row, first, last + 1) of repeats, by bytes of the row's context."""
        if self.symbols:
            for place, n in zip(self.places, longest_repeats(self.symbols, self.widths), strict=True):
                if place and n >= WINDOW:
                    yield place[0], place[1], place[1] + n
        self.clear()


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 20, (pos >> 10) & 1023, pos & 1023


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over contexts sorted by anchor hash: spans (did, tx, first, last + 1) of those that occur once."""
    sorter = _Sorter()
    for rows, starts in grouped(batches, ["h"]):
        did, tx = rows.column("did").to_numpy(), rows.column("tx").to_numpy()
        start, anchor, _ = _unpack(rows.column("pos").to_numpy())
        once = rows.column("n").to_numpy() == 1
        body = rows.column("body").to_pylist()
        anchors, found = anchor.tolist(), []
        for g in range(len(starts) - 1):
            members = [(r, body[r], anchors[r]) for r in range(starts[g], starts[g + 1])]
            sorter.add(g, members)
            if len(sorter.symbols) >= SYMBOLS:
                found += sorter.repeats()
        found += sorter.repeats()
        found = [x for x in found if once[x[0]]]
        if found:
            r, a, b = np.array(found, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(did[r]), pa.array(tx[r]), pa.array(start[r] + a), pa.array(start[r] + b)], ["did", "tx", "a", "b"])


def _ranges(size: int):
    """A row for each range of window offsets that a context owns part of: (h, u, core, full, full2, did, tx, pos, once).

    Offsets u to u + size - 1 (bytes before the anchor). core digests the bytes that all windows of the range share,
    full those that any of them covers; a context that does not own the whole range gets a full of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            start, anchor, last = (x.tolist() for x in _unpack(batch.column("pos").to_numpy()))
            bodies = batch.column("body").to_pylist()
            keys = zip(*(batch.column(c).to_pylist() for c in ("h", "did", "tx", "pos", "once", "u", "span")), strict=True)
            for k, (h, did, tx, pos, once, u0, span) in enumerate(keys):
                body, at, low = bodies[k], anchor[k], anchor[k] - last[k]
                for u in range(u0, u0 + span, size):
                    v = u + size - 1
                    if u > at or v < low:
                        continue
                    core = hashlib.blake2b(body[at - u : at + WINDOW - v], digest_size=8).digest()
                    whole = body[at - v : at + WINDOW - u] if u >= low and v <= at else b"%d %d %d" % (did, tx, pos)
                    full = hashlib.blake2b(whole, digest_size=16).digest()
                    halves = (int.from_bytes(x, "little", signed=True) for x in (core, full[:8], full[8:]))
                    out.append((h, u, *halves, did, tx, pos, once))
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 8 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h", "u", "core", *FULL, "did", "tx", "pos", "once"])

    return run


def _split_groups(contexts: DataFrame) -> DataFrame:
    """Spans of large groups: (did, tx, a, b). contexts: (h, n, did, tx, pos, body).

    Ranges of window offsets are cut finer level by level. Contexts with the same full bytes of a range repeat all
    its windows. Contexts with a core that no other has repeat none. Where contexts share a core and differ in full,
    the range is cut finer; each class of equal contexts goes on as one. A passage has two ends, so about two ranges
    of a context go on, and no task gathers a group.
    """
    base = settle(contexts.select("h", "did", "tx", "pos", (F.col("n") == 1).alias("once"), F.lit(0).cast("long").alias("u"), F.lit(WINDOW).cast("long").alias("span"), "body"), "large")
    now, found = base, None
    for size in LEVELS:
        rows = settle(now.mapInArrow(_ranges(size), "h long, u long, core long, full long, full2 long, did long, tx long, pos long, once boolean"), "ranges")
        classes = settle(rows.groupBy("h", "u", "core", *FULL).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("did", "tx", "pos", "once")).alias("one")), "classes")
        whole = rows.filter("once").join(classes.filter("k > 1").select("h", "u", *FULL), ["h", "u", *FULL], "left_semi")
        anchor = F.shiftright("pos", 20) + F.shiftright("pos", 10).bitwiseAND(F.lit(1023))
        spans = settle(whole.select("did", "tx", (anchor - F.col("u") - (size - 1)).alias("a"), (anchor - F.col("u") + WINDOW).alias("b")), "spans")
        found = spans if found is None else found.unionByName(spans)
        discard(rows)
        if size == 1:
            discard(classes)
            break
        mixed = settle(classes.groupBy("h", "u", "core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h", "u", "core"), "mixed")
        on = classes.join(mixed, ["h", "u", "core"], "left_semi").select("h", "u", "one.did", "one.tx", "one.pos", (F.col("one.once") & (F.col("k") == 1)).alias("once"), F.lit(size).cast("long").alias("span"))
        last, now = now, settle(on.join(base.select("h", "did", "tx", "pos", "body"), ["h", "did", "tx", "pos"]), "unsettled")
        if last is not base:
            discard(last)
        discard(classes)
        discard(mixed)
    return found


# --- the operator ----------------------------------------------------------------------------------------------------


def repeated_spans(rows: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """rows: (did, tx, body). Spans (did, tx, a, b) whose union is what goes; b is exclusive."""
    spark = rows.sparkSession
    anchors = settle(rows.filter(F.octet_length("body") >= WINDOW).mapInArrow(_anchors, "h long, cx long, cy long, did long, tx long, pos long"), "anchors")
    often = settle(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "hashes")
    shared = settle(anchors.join(often, "h", "left_semi"), "shared")
    discard(anchors)
    discard(often)
    release(spark)
    classes = settle(shared.groupBy("h", *CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "tx", "pos")).alias("one")).select("h", *CONTEXT, "n", "one.*"), "classes")
    whole = shared.join(classes.filter("n > 1").select("h", *CONTEXT), ["h", *CONTEXT], "left_semi")
    first, last = F.shiftright("pos", 20), F.col("pos").bitwiseAND(F.lit(1023))
    whole = settle(whole.select("did", "tx", first.alias("a"), (first + last + WINDOW).alias("b")), "whole")
    discard(shared)
    several = settle(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "several")
    asked = classes.join(several, "h").select("h", "n", "did", "tx", "pos", "m")
    texts = rows.filter(F.octet_length("body") >= WINDOW).dropDuplicates(["did", "tx"])
    cut = asked.join(texts, ["did", "tx"]).select("h", "n", "did", "tx", "pos", "m", F.expr(f"substring(body, cast(shiftright(pos, 20) as int) + 1, cast((pos & 1023) + {WINDOW} as int))").alias("body"))
    contexts = settle(cut, "contexts")
    discard(classes)
    release(spark)
    few = contexts.filter(F.col("m") <= group_limit).repartition("h").sortWithinPartitions("h")
    parts = settle(few.select("h", "n", "did", "tx", "pos", "body").mapInArrow(_solve, "did long, tx long, a long, b long"), "parts")
    spans = whole.unionByName(parts)
    many = contexts.filter(F.col("m") > group_limit)
    if not several.filter(F.col("m") > group_limit).isEmpty():
        spans = spans.unionByName(_split_groups(many))
    discard(several)
    discard(contexts)
    release(spark)
    return spans


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans [a, b); spans that touch are one run."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)
    return a[new], b[ends]


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            removed, runs, digest = 0, 0, hashlib.sha256()
            at = 0
            if spans:
                v = np.array([(x["a"], x["b"]) for x in spans], dtype=np.int64)
                a, b = merged(v[:, 0], v[:, 1])
                runs, removed = len(a), int((b - a).sum())
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    digest.update(body[at:x])
                    at = y
            digest.update(body[at:])
            out["n_removed"].append(removed)
            out["n_spans"].append(runs)
            out["kept_sha256"].append(digest.hexdigest())
        n = pa.array([len(x) for x in batch.column("body").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), n, pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(body).alias("tx"), body.cast("binary").alias("body"))


def spans_by_row(rows: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(did, tx, spans): the spans of each row that has any."""
    spans = repeated_spans(rows.select("did", "tx", "body"), group_limit)
    return settle(spans.groupBy("did", "tx").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256. Ids are integers."""
    rows = _identified(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.join(spans_by_row(rows, group_limit), ["did", "tx"], "left").select("id", "body", "spans")
    return found.mapInArrow(_removal, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and what is left of its bytes (kept, binary; a cut may fall inside a character)."""
    rows = _identified(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                if spans:
                    v = np.array([(x["a"], x["b"]) for x in spans], dtype=np.int64)
                    for x, y in zip(*(z.tolist() for z in merged(v[:, 0], v[:, 1])), strict=True):
                        parts.append(body[at:x])
                        at = y
                out.append(b"".join([*parts, body[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "kept"])

    found = rows.join(spans_by_row(rows), ["did", "tx"], "left").select("id", "body", "spans")
    return found.mapInArrow(run, f"id {kind}, kept binary").withColumnRenamed("id", id_col)
