"""Exact deduplication by a tree-merge of sorted digest runs.

Every row is dealt to one of 2**R nodes (leaves), as many as the session has shuffle partitions, rounded up. A node's
run holds one row per digest: the identifier retained so far and the number of rows. In round r a node exchanges
with the one whose address differs in bit r: runs go where bit r of the address equals bit r of the digest, so what
arrives at a node are the sorted runs of two partners, which it merges, retaining one identifier per digest again.
For each slice of the digest space these rounds form a binomial tree over all nodes; after R rounds its root holds
that slice from all leaves. No task ever sees more than its share, however large a group of copies is, since a node
sends one row per digest. A larger fan_in lets that many partners meet in a round, in fewer rounds.

The way down goes by the leaves as well: a digest's result is handed to the leaves that hold it, and rows are joined
on (leaf, digest), so a group that holds a third of all rows is spread over all leaves, null ids included.

"Verified": the key is SHA-256 of the normalised text with its byte length, not a short hash.

Defined results: null text counts as empty (all such rows are one group). Null ids lose against any id; a group with
null ids only keeps one of its rows, with keep_id null. Of repeated rows with the same id and text, one stays. A very
long text is hashed whole and never moved. An empty table gives no rows. Extra columns, whatever their names (keep_id
among them), are ignored by exact_groups and kept by drop_copies; only names that begin with _fm_ are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, shuffle_partitions

KEY = ["_fm_sha", "_fm_len"]
WRITE_EVERY = 4  # rounds after which runs are written, which cuts the lineage


def _digests(docs: DataFrame, id_col: str, text_col: str, nodes: int) -> DataFrame:
    """A row per document, numbered (_fm_u), at its leaf. To be written once: the numbers are those of one run."""
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("_fm_id"),
        F.unhex(F.sha2(norm, 256)).alias("_fm_sha"),
        F.octet_length(norm).cast("long").alias("_fm_len"),
        F.monotonically_increasing_id().alias("_fm_u"),
    )
    return rows.withColumn("_fm_leaf", F.pmod(F.xxhash64("_fm_u"), F.lit(nodes)).cast("int"))


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a node's merged runs, sorted by key and then best identifier first; keep the first and the sum per key."""
    held: pa.RecordBatch | None = None  # the last group so far, as one row
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = False
        for k in KEY:
            col = batch.column(k)
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(batch.column("_fm_n").to_numpy(), starts)
        runs = batch.take(pa.array(starts))
        if held is not None:
            if all(held.column(k)[0] == runs.column(k)[0] for k in KEY):
                counts[0] += held.column("_fm_n")[0].as_py()
                runs = pa.Table.from_batches([held, runs.slice(1)]).combine_chunks().to_batches()[0]
            else:
                yield held
        runs = runs.set_column(runs.schema.get_field_index("_fm_n"), "_fm_n", pa.array(counts, pa.int64()))
        yield runs.slice(0, runs.num_rows - 1)
        held = runs.slice(runs.num_rows - 1)
    if held is not None:
        yield held


def _merge(runs: DataFrame, node: Column, nodes: int, keep: str) -> DataFrame:
    """Send runs to their nodes (a partition each) and merge what meets there: one row per digest."""
    best = F.col("_fm_id").asc_nulls_last() if keep == "min" else F.col("_fm_id").desc_nulls_last()
    sent = runs.select(node.cast("int").alias("_fm_node"), "_fm_id", "_fm_u", *KEY, "_fm_n").repartitionById(nodes, F.col("_fm_node"))
    return sent.sortWithinPartitions(*KEY, best, "_fm_u").mapInArrow(_merge_runs, sent.schema)


def rounds_of(nodes: int, fan_in: int = 2) -> list[int]:
    """The weight of each round's digit of an address: 1, fan_in, fan_in**2 and so on below nodes."""
    out = []
    while (w := fan_in ** len(out)) < nodes:
        out.append(w)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 2, nodes: int | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. keep: "min" or "max" identifier of a group stays."""
    weights = rounds_of(nodes or shuffle_partitions(docs.sparkSession), fan_in)
    nodes = fan_in ** len(weights)
    rows = settle(_digests(docs, id_col, text_col, nodes), "digests")
    merged = _merge(rows.withColumn("_fm_n", F.lit(1).cast("long")), F.col("_fm_leaf"), nodes, keep)
    leaves = settle(merged, "runs")
    now, at, home = leaves, F.col("_fm_node"), F.pmod(F.xxhash64(*KEY), F.lit(nodes)).cast("int")
    for k, w in enumerate(weights):
        digit = lambda x, w=w: F.floor(x / w).cast("int") % fan_in
        now = _merge(now, at + (digit(home) - digit(at)) * w, nodes, keep)
        if k % WRITE_EVERY == WRITE_EVERY - 1 and k < len(weights) - 1:
            now = settle(now, "runs")
    groups = settle(now.filter("_fm_n > 1").select(*KEY, F.col("_fm_id").alias("_fm_keep"), F.col("_fm_u").alias("_fm_best"), F.col("_fm_n").alias("_fm_size")), "groups")
    down = leaves.select(F.col("_fm_node").alias("_fm_leaf"), *KEY).join(groups, KEY)
    found = rows.join(down, ["_fm_leaf", *KEY], "left")
    alone = F.col("_fm_size").isNull()
    return found.select(
        F.col("_fm_id").alias(id_col),
        F.when(alone, F.col("_fm_id")).otherwise(F.col("_fm_keep")).alias("keep_id"),
        F.coalesce("_fm_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_fm_u") == F.col("_fm_best"))).alias("kept"),
        F.lower(F.hex("_fm_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    # plain keys that are never null: the join leaves the rows where dropDuplicates needs them, so texts move once
    name = F.concat(F.when(F.col(id_col).isNull(), "n").otherwise("v"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_fm_name")
    groups = exact_groups(docs, id_col, text_col, keep).filter("kept")
    stay = settle(groups.select(name, F.unhex("text_sha256").alias("_fm_dsha")), "kept")
    keyed = docs.select("*", name, F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("_fm_dsha"))
    once = keyed.join(stay.hint("merge"), ["_fm_name", "_fm_dsha"], "left_semi").dropDuplicates(["_fm_name", "_fm_dsha"])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha
  FROM documents
), g AS (SELECT sha, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY sha)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY d.doc_id, d.sha) = 1 AS kept,
       d.sha AS text_sha256
FROM d JOIN g ON d.sha = g.sha
"""
