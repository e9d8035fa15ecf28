"""Exact top-k inner products: a pivot-distance index.

Inner products become distances: with M the largest norm, a vector x gets one more coordinate sqrt(M^2 - |x|^2) and a
query a zero, so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x and the largest product is the smallest distance. Every vector is
keyed by its nearest pivot and its distance to it; sorted by (pivot, distance, id), the keys of each pivot are cut into
annuli of at most about SEGMENT rows. The number of pivots grows with the square root of the table's.

Queries with a common nearest pivot form blocks. A block takes the annuli in the order of the best bound that the
triangle inequality leaves any of its queries, a growing number a round; after each round every query's k-th score is
raised, and an annulus that no query of the block can still gain from is skipped for good. The search of a block ends
when all that is left is excluded. Bounds are widened by a relative 1e-9; scores are integer sums, so the result is exact.

Scale: pivots are fitted on a bounded sample (SAMPLE rows, the smallest hashes of ids); every row is indexed. What is
planned and written is (block, annulus), never (query, annulus); a task holds one annulus and one block, and returns
only rows that beat a query's k-th score so far. The directory of annuli is sent with the tasks and has at most
DIRECTORY + PIVOTS rows: on larger tables annuli grow instead. Annuli are cut by row count with the id as tie-break, so
a vector that a third of all rows share fills many of them, not one.

Where all distances are alike (random vectors of many dimensions) the bounds exclude next to nothing and the search
becomes a block-wise scan; the README has the shares.

Defined results: null vectors, null ids and vectors with null or non-finite components take no part, neither as query
nor as candidate. Shorter vectors count as padded with zeros. Rows that repeat an id are candidates each; as a query
the id counts once, by its smallest vector. An empty table gives no rows. Other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, settle

PIVOTS = (16, 1024)  # least and most
SAMPLE = 4096
SEGMENT = 4096
DIRECTORY = 1 << 20
QUERY_BLOCK = 2048
FIRST_STEP, GROWTH = 1, 4  # annuli a block takes in the first round, and the factor by which that grows
SLACK = 1e-9


def _matrix(blobs, width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width), dtype=np.int64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, dtype="<i8")
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in float64 where every partial sum is below 2**53, else in int64 or Python integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**63:
        return q @ x.T
    return (q.astype(object) @ x.T.astype(object)).clip(-(2**63), 2**63 - 1).astype(np.int64)


def _lifted(x: np.ndarray, m2: float) -> np.ndarray:
    v = x.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, m2 - (v * v).sum(axis=1)))
    return np.hstack([v, rest[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means from evenly spaced sample rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(axis=1)
        for k in range(len(centres)):
            own = sample[near == k]
            if len(own):
                centres[k] = own.mean(axis=0)
    return centres


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v): v holds floor(scale * x) as little-endian 64-bit integers; rows that take no part are left out."""
    x = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))

    def pack(batches):
        for batch in batches:
            col = batch.column("ints")
            flat, offsets = col.flatten().to_numpy(zero_copy_only=False).astype("<i8"), np.asarray(col.offsets)
            offsets = offsets - offsets[0]
            blobs = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], ["id", "v"])

    return vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), ints.alias("ints")).mapInArrow(pack, "id long, v binary")


def _facts(rows: DataFrame) -> tuple[int, int, float]:
    """Number of rows, widest vector and largest squared norm."""

    def run(batches):
        for batch in batches:
            blobs = batch.column("v").to_pylist()
            if blobs:
                width = max(len(b) for b in blobs) // 8
                m = _matrix(blobs, width).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"n": [len(blobs)], "w": [width], "m": [float((m * m).sum(axis=1).max(initial=0.0))]})

    r = rows.mapInArrow(run, "n long, w long, m double").agg(F.sum("n"), F.max("w"), F.max("m")).first()
    return r[0] or 0, r[1] or 0, r[2] or 0.0


class _Directory:
    """The annuli: pivot, least and largest distance, rows; and the pivots. Bounded, and sent with the tasks."""

    def __init__(self, rings: pa.Table, centres: np.ndarray, width: int, m2: float):
        self.ring, self.pivot, self.rows = (rings.column(c).to_numpy() for c in ("ring", "pivot", "rows"))
        self.near, self.far = rings.column("near").to_numpy(), rings.column("far").to_numpy()
        self.at = {r: k for k, r in enumerate(self.ring.tolist())}
        self.centres, self.width, self.m2 = centres, width, m2

    def queries(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Query vectors, and their distances to all pivots."""
        q = _matrix(blobs, self.width)
        return q, _distances(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), self.centres)

    def bounds(self, q2: np.ndarray, dq: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The largest product that each query may find in each of the annuli."""
        d = dq[:, self.pivot[which]]
        low = np.maximum(0.0, np.maximum(d - self.far[which], self.near[which] - d))
        whole = (q2 + self.m2)[:, None]
        return (whole - low * low) / 2 + whole * SLACK


def _squares(q: np.ndarray) -> np.ndarray:
    v = q.astype(np.float64)
    return (v * v).sum(axis=1)


def _plan(held: _Directory, step: int) -> Callable:
    """For one block: its next annuli. (block, ring, place in the block's order, live: queries that may gain)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        q, dq = held.queries(p["qv"].tolist())
        q2, least = _squares(q), p["least"].to_numpy(dtype=np.float64, na_value=-np.inf)
        n = len(held.ring)
        best, live = np.empty(n), np.empty(n, dtype=np.int64)
        for at in range(0, n, 4096):
            which = np.arange(at, min(at + 4096, n))
            b = held.bounds(q2, dq, which)
            best[which], live[which] = b.max(axis=0), (b >= least[:, None]).sum(axis=0)
        order = np.lexsort((held.ring, -best))
        place = np.arange(n)
        keep = (place >= p["turn"].iloc[0]) & (live[order] > 0)
        order, place = order[keep][:step], place[keep][:step]
        return pd.DataFrame({"block": np.full(len(order), p["block"].iloc[0]), "ring": held.ring[order], "place": place, "live": live[order]}).astype("int64")

    return run


def _meet(held: _Directory, k: int) -> Callable:
    """One annulus and one block: the rows that may be among a query's k best."""

    def run(key: tuple, x: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if not x.empty and not p.empty:
            x = x.sort_values("id", kind="stable")
            ids, items = x["id"].to_numpy(), _matrix(x["v"].tolist(), held.width)
            q, dq = held.queries(p["qv"].tolist())
            least = p["least"].to_numpy(dtype=np.float64, na_value=-np.inf)
            reach = np.flatnonzero(held.bounds(_squares(q), dq, np.array([held.at[int(key[0])]]))[:, 0] >= least)
            q, qids, least = q[reach], p["query_id"].to_numpy()[reach], least[reach]
            for at in range(0, len(qids), 256):
                for row, qid, floor in zip(_products(q[at : at + 256], items), qids[at : at + 256], least[at : at + 256], strict=True):
                    other = np.flatnonzero((ids != qid) & (row >= floor))
                    s = row[other]
                    if len(s) > k:
                        keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        s, other = s[keep], other[keep]
                    best = np.lexsort((ids[other], -s.astype(object) if s.min(initial=0) == -(2**63) else -s))[:k]
                    if len(best):
                        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[other[best]], "score": s[best]}))
        return pd.concat(out, ignore_index=True).astype("int64")

    return run


def index_of(rows: DataFrame, n: int, width: int, m2: float, segment: int = SEGMENT) -> tuple[DataFrame, _Directory]:
    """rows (id, v) keyed by annulus: (ring, id, v), and the directory."""
    sample = _matrix([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], width)
    centres = fit_pivots(_lifted(sample, m2), min(PIVOTS[1], max(PIVOTS[0], math.isqrt(n) // 2)))

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column("v").to_pylist(), width), m2), centres)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int64)), pa.array(d[np.arange(len(d)), near])], ["id", "v", "pivot", "dist"])

    size = max(segment, n // DIRECTORY)
    found = rows.mapInArrow(keyed, "id long, v binary, pivot long, dist double").repartitionByRange(max(1, -(-n // size)), "pivot", "dist", "id")
    found = settle(found.withColumn("ring", F.spark_partition_id().cast("long") * len(centres) + F.col("pivot")), "index")
    rings = found.groupBy("ring", "pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far"), F.count(F.lit(1)).alias("rows")).orderBy("ring").toArrow()
    return found.select("ring", "id", "v"), _Directory(rings, centres, width, m2)


def search(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, segment: int = SEGMENT) -> tuple[DataFrame, float]:
    """The result of top_k, and the share of all (query, row) pairs that the bounds did not exclude."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if queries is None:
        queries = vectors.filter(F.col(id_col) % 50 == 0)
    rows = settle(quantised(vectors, id_col, vec_col, scale), "vectors")
    asked = settle(quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, width, m2 = _facts(rows)
    nq, q_width, _ = _facts(asked)
    if not n or not nq:
        return empty, 0.0
    index, held = index_of(rows, n, max(width, q_width), m2, segment)
    discard(rows)

    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                near = held.queries(batch.column("v").to_pylist())[1].argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int64))], ["query_id", "qv", "near"])

    blocks = asked.mapInArrow(nearest, "query_id long, qv binary, near long").repartitionByRange(max(1, -(-nq // QUERY_BLOCK)), "near", "query_id")
    blocks = settle(blocks.select("query_id", "qv", F.spark_partition_id().cast("long").alias("block")), "blocks")
    discard(asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    state, top, step, scored = blocks.withColumn("least", F.lit(None).cast("long")).withColumn("turn", F.lit(0).cast("long")), None, FIRST_STEP, 0
    while True:
        plan = settle(state.groupBy("block").applyInPandas(_plan(held, step), "block long, ring long, place long, live long"), "plan")
        taken = plan.groupBy("ring").agg(F.sum("live").alias("live")).toArrow()  # a row for each annulus: bounded like the directory
        if not taken.num_rows:
            return (empty if top is None else top.withColumn("rank", F.row_number().over(order).cast("int")).select("query_id", "rank", "vec_id", "score")), scored / (n * nq)
        scored += int(sum(held.rows[held.at[r]] * int(m) for r, m in zip(taken.column("ring").to_pylist(), taken.column("live").to_pylist(), strict=True)))
        pairs = plan.select("ring", "block")
        mine = index.join(pairs, "ring").groupBy("ring", "block")
        theirs = state.select("block", "query_id", "qv", "least").join(pairs, "block").groupBy("ring", "block")
        found = mine.cogroup(theirs).applyInPandas(_meet(held, k), "query_id long, vec_id long, score long")
        both = found if top is None else top.unionByName(found)
        last, top = top, settle(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "top")
        discard(last)
        least = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("least")).filter(F.col("m") >= k).drop("m")
        turns = plan.groupBy("block").agg((F.max("place") + 1).alias("turn"))
        state = settle(blocks.join(least, "query_id", "left").join(turns, "block"), "state")
        discard(plan)
        step *= GROWTH


def top_k(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products with any other row.

    queries: rows of the same form; left out, the rows of vectors whose id is divisible by 50.
    """
    return search(vectors, queries, id_col, vec_col, k, scale, SEGMENT)[0]


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
