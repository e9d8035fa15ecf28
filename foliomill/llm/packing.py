"""Best-fit packing with conflicts: sequences of at most CAPACITY tokens from whole documents.

Documents longer than a bin are cut into full pieces and a rest; pieces are packed longest first. Open bins lie in
order of what they have left. Each bin carries bitmaps: the duplicate clusters it holds, and for each source the
number of pieces so far as PER_SOURCE bit planes. A piece looks for the successor of its length and walks on until the
first bin whose bitmaps allow it, which is the tightest compatible bin; a new bin is opened where none is.

A bin takes at most PER_SOURCE pieces of a source and at most one of a duplicate cluster: of documents that are equal
after lower-casing (128 bits of a digest), or of those that a table of clusters names, near copies say. A document's own
pieces count as one cluster too.

Scale: pieces are dealt to shards of about SHARD pieces by a hash of their id, copy and piece, so that repeated rows and
the pieces of one document spread too. Only ids, lengths and keys move, never texts; a shard is packed in one task of
bounded size, whatever a source or cluster holds. Bins that are not CLOSED full are opened again and their pieces dealt
to new shards, as few as hold them, round after round, until one shard holds all that is left or a round no longer
takes a quarter of it. So part-filled bins of different shards meet, and at most the last round's are left.

Defined results: null and empty texts have no token; they get no bin (null) and piece 0, so no row is lost. A null
source is a source of its own. Repeated rows are packed each. Very long texts give as many full pieces as they hold.
Ties go to the smaller id, then to the bin opened first. An empty table gives no rows. Other columns, whatever their
names (bin among them), are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

CAPACITY = 8192
PER_SOURCE = 4
SHARD = 4096
CLOSED = 0.98  # a bin this full is not opened again


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, taken in the order given. sources and clusters are small integers."""
    open_bins: list[tuple[int, int]] = []  # (what is left, bin), in order
    planes: list[list[int]] = []  # for each bin: per_source bitmaps of sources
    held: list[int] = []  # for each bin: bitmap of clusters
    out = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        source, cluster = 1 << s, 1 << c
        at = bisect_left(open_bins, (n, -1))
        while at < len(open_bins) and (held[open_bins[at][1]] & cluster or planes[open_bins[at][1]][-1] & source):
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(held)
            planes.append([0] * per_source)
            held.append(0)
        for k in range(per_source):
            if not planes[b][k] & source:
                planes[b][k] |= source
                break
        held[b] |= cluster
        out.append((b, capacity - left))
        if left > n:
            insort(open_bins, (left - n, b))
    return out


def _packed(capacity: int, per_source: int):
    """Over the pieces of one shard: the same rows with bin and bin_offset."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        q = p.drop(columns=["bin", "bin_offset"]).sort_values(["n_tokens", "id", "copy", "cluster", "piece"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        sources = pd.factorize(q["source"], use_na_sentinel=False)[0].tolist()
        clusters = pd.factorize(q["cluster"])[0].tolist()
        placed = best_fit(q["n_tokens"].tolist(), sources, clusters, capacity, per_source)
        q["bin"], q["bin_offset"] = [b for b, _ in placed], [o for _, o in placed]
        return q[list(p.columns)]

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, clusters: DataFrame | None = None, closed: float = CLOSED
) -> DataFrame:
    """One row per piece: id, copy, piece, start, n_tokens, shard, bin, bin_offset. Tokens are runs of non-spaces.

    clusters: (id, cluster) of documents that must not share a bin, an id once; others fall back on the digest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n"),
        F.col(source_col).cast("string").alias("source"),
        F.md5(F.lower(text)).alias("cluster"),
    )
    # repeated rows are numbered through a row of their own, so that they can go to different shards
    counted = rows.groupBy("id", "n", "source", "cluster").agg(F.count(F.lit(1)).alias("copies"))
    if clusters is not None:
        named = clusters.toDF("_fm_c", "_fm_cluster")
        counted = counted.join(named, F.col("id") == F.col("_fm_c"), "left").withColumn("cluster", F.coalesce(F.concat(F.lit("c"), F.col("_fm_cluster").cast("string")), "cluster"))
    each = counted.select("id", "n", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / capacity).cast("long") - 1)
    cut = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).withColumn("start", F.col("piece") * capacity)
    cut = cut.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start"))).drop("n")
    pieces = settle(cut, "pieces")
    out = ["id", "copy", "piece", "start", "n_tokens", "shard", "bin", "bin_offset"]
    none = [F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("bin_offset")]
    found = pieces.filter("n_tokens = 0").select(*out[:5], *none)
    left = pieces.filter("n_tokens > 0")
    n, base, again = left.count(), 0, 0
    while n:
        shards = max(1, -(-n // shard))
        dealt = left.select("id", "copy", "piece", "start", "n_tokens", "source", "cluster", (F.pmod(F.xxhash64("id", "copy", "piece", "cluster", F.lit(again)), F.lit(shards)) + base).cast("int").alias("shard"), *none[1:])
        placed = settle(dealt.groupBy("shard").applyInPandas(_packed(capacity, per_source), dealt.schema), "placed")
        if shards == 1:
            return found.unionByName(placed.select(*out)).withColumnRenamed("id", id_col)
        fill = placed.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("fill"))
        part = settle(fill.filter(F.col("fill") < closed * capacity).select(F.col("shard").alias("_fm_s"), F.col("bin").alias("_fm_b")), "part")
        same = (F.col("shard") == F.col("_fm_s")) & (F.col("bin") == F.col("_fm_b"))
        left = placed.join(part, same, "left_semi")
        now = left.count()
        if not now or 4 * now > 3 * n:  # a round must take a quarter of what is left, or its bins stay
            return found.unionByName(placed.select(*out)).withColumnRenamed("id", id_col)
        found = found.unionByName(placed.join(part, same, "left_anti").select(*out))
        n, base, again = now, base + shards, again + 1
    return found.withColumnRenamed("id", id_col)
