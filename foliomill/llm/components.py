"""Connected components of an edge list, by rounds of local union-find and pointer jumping.

A round sends every edge to the partition of its larger end, hooks all smaller ends of a vertex to the smallest of them,
contracts what lies there with union-find (in chunks of bounded size) into edges from each vertex to the smallest one
it reached, and then lets every vertex point past its root to the root's own root. Edges are only ever replaced by
edges of the same component, so no round can lose a link; rounds end when every vertex has one root and no root has
another. Each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

CHUNK = 500_000


def find_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges (a[i], b[i]): every vertex that is not the smallest of its component, and that smallest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for u, v in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        u, v = root(u), root(v)
        if u < v:
            parent[v] = u
        elif v < u:
            parent[u] = v
    roots = np.fromiter((root(x) for x in range(len(names))), dtype=np.int64, count=len(names))
    own = roots != np.arange(len(names))
    return names[own], names[roots[own]]


def _hooked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges sorted by (u, v), batch by batch: each u points to its smallest target, and so do its other targets.

    The smallest target is carried over from batch to batch, so it does not matter how many edges a vertex has.
    """
    at = least = None
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        if not len(u):
            continue
        new = np.append(True, u[1:] != u[:-1])
        first = v[np.flatnonzero(new)]
        if at is not None and u[0] == at:
            new[0], first[0] = False, least
        m = first[np.cumsum(np.append(True, u[1:] != u[:-1])) - 1]
        at, least = u[-1], m[-1]
        other = v != m
        yield np.concatenate([u[new], v[other]]), np.concatenate([m[new], m[other]])


def _contract(chunk: int):
    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = find_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for u, v in _hooked(batches):
            held.append((u, v))
            n += len(u)
            if n >= chunk:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _finished(edges: DataFrame) -> bool:
    """Whether every u has one target and no target points on: then each target is the smallest of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return seen.filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every vertex that is not the smallest of its component. a and b are long and not null."""
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if _finished(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        near = settle(now.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_contract(chunk), "u long, v long").distinct(), "stars")
        far = near.select(F.col("u").alias("w"), F.col("v").alias("x"))
        jumped = near.join(far, F.col("v") == F.col("w"), "left").select("u", F.coalesce("x", "v").alias("v"))
        nxt = settle(jumped.distinct(), "edges")
        discard(now)
        discard(near)
        now = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
