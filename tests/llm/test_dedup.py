import hashlib
import random

import numpy as np
import pytest
import xxhash

from foliomill.llm import components as cc
from foliomill.llm import exactdedup, simhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


ROWS = [
    (1, "Hello World", "x"), (2, "hello world", "y"), (3, "HELLO WORLD", "x"), (4, None, "z"), (5, "", "z"), (6, "É", "a"), (7, "é", "b"),
    (8, "alone", None), (8, "alone", None), (9, "word " * 5000, "c"), (10, "Word " * 5000, "d"), (None, "hello world", "n"), (None, "null only", "n"), (None, "null only", "n"),
]
DDL = "doc_id long, text string, keep_id string"


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    got = exactdedup.exact_groups(spark.createDataFrame(ROWS, DDL), keep=keep).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.keep_id == ((min if keep == "min" else max)(ids) if ids else None)
        assert r.group_size == len(groups[r.text_sha256])
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(groups)


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    df = spark.createDataFrame(ROWS, DDL)
    got = exactdedup.drop_copies(df, keep="max")
    assert got.columns == df.columns
    assert sorted(lower(r.text) for r in got.collect()) == sorted({lower(t) for _, t, _ in ROWS})


def test_exact_with_clashing_names_and_a_long_text(spark):
    long = "Long " * 400_000
    df = spark.createDataFrame([(1, long, 5, "a"), (2, long.lower(), 6, "b"), (3, None, 7, "c")], "doc_id long, text string, group_size long, kept string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_groups(df, keep="max").collect()) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    kept = exactdedup.drop_copies(df, keep="max")
    assert kept.columns == df.columns and sorted((r.doc_id, r.group_size, r.kept) for r in kept.collect()) == [(2, 6, "b"), (3, 7, "c")]


def test_exact_empty(spark):
    assert exactdedup.exact_groups(spark.createDataFrame([], DDL)).count() == 0
    assert exactdedup.drop_copies(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize(("nodes", "fan_in"), [(1, 2), (8, 2), (27, 3), (5, 2)])
def test_hot_group_is_spread(spark, nodes, fan_in):
    df = spark.range(3000).selectExpr("if(id % 10 = 0, null, id) as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    got = exactdedup.exact_groups(df, keep="max", fan_in=fan_in, nodes=nodes)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 2997").count() == 1000


def test_rounds_are_binomial(spark):
    assert exactdedup.rounds_of(211) == [1, 2, 4, 8, 16, 32, 64, 128] and exactdedup.rounds_of(1) == []
    df = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text")
    plan = exactdedup._digests(df, "doc_id", "text", 8)
    assert plan.select("_fm_leaf").distinct().count() == 8


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints(monkeypatch):
    rng = random.Random(3)
    texts = ["", "  \t\n", "one", "One two THREE", "a b c d", "a\x0bb\x0cc d e", "É é ü x y", " ".join(rng.choice("abcdefgh") for _ in range(700)), "w " * 900]
    for piece in (1 << 22, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for t in texts:
            assert simhash.fingerprint(t.encode()) & (2**64 - 1) == brute_fingerprint(t), (piece, t[:20])


def clusters(fps, radius=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("limit", [simhash.LIST_LIMIT, 20])
def test_links_span_all_components(spark, limit):
    rng = random.Random(limit)
    fps = [rng.getrandbits(64) - 2**63 for _ in range(250)]
    for base in fps[:12]:
        for _ in range(12):
            f = base & (2**64 - 1)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                f ^= 1 << b
            fps.append(f - 2**64 if f >> 63 else f)
    fps += [0, 1, 3, 7, 15, 31, 2**40, -1, -2]
    want = clusters(fps)
    df = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    got = {r.node: r.root for r in cc.components(simhash.links(df, limit), "a", "b").collect()}
    assert {f: got.get(f, f) for f in want} == want


def test_near_duplicates_end_to_end(spark):
    rng = random.Random(1)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(40)) for _ in range(400)]
    near = base.copy()
    near[200] = "changed"
    rows = [(10, " ".join(base), "s"), (11, " ".join(near), "s"), (12, " ".join(base).upper(), "s"), (13, "other words here now then", "s"), (14, None, "s"), (15, "", "s"), (16, "  ", "s"), (12, " ".join(base), "s"), (None, "null id text", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = [brute_fingerprint(t) for _, t, _ in rows]
    assert sorted(r.fingerprint for r in got) == sorted(f"{f:016x}" for f in fp)
    group = clusters(fp)
    for r in got:
        members = [i for (i, _, _), f in zip(rows, fp, strict=True) if group[f] == group[int(r.fingerprint, 16)] and i is not None]
        assert r.component_id == (min(members) if members else None)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_pairs_come_from_the_distance_table(spark, monkeypatch):
    """Without the table's coordinates no pair is found: the keys, the windows and the discards all read it."""
    rng = random.Random(9)
    fps = [rng.getrandbits(64) - 2**63 for _ in range(60)]
    fps += [f ^ (1 << rng.randrange(63)) for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert simhash.links(df).count() >= 60
    own = simhash.distance_table

    def scrambled(x):
        return np.random.default_rng(abs(int(x.sum())) % 1000).permuted(own(x), axis=1)

    seen = []
    monkeypatch.setattr(simhash, "distance_table", lambda x: (seen.append(len(x)), scrambled(x))[1])
    listed = [b for c in simhash.CUTS[:1] for b in simhash._listed(c)(iter([simhash.pa.RecordBatch.from_arrays([simhash.pa.array(fps)], ["fp"])]))]
    assert seen and len(listed) == 15
    keys = [dict(zip(b.column("fp").to_pylist(), b.column("key").to_pylist(), strict=True)) for b in listed]
    meet = sum(any(k[f] == k[g] for k in keys) for f, g in zip(fps[:60], fps[60:], strict=True))
    assert meet < 30


def test_keys_meet_for_every_link():
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    b = a.copy()
    for _ in range(4):
        b ^= np.int64(1) << rng.integers(0, 63, 300)
    for cut in simhash.CUTS:
        x, y = ([r.column("key").to_numpy() for r in simhash._listed(cut)(iter([simhash.pa.RecordBatch.from_arrays([simhash.pa.array(v)], ["fp"])]))] for v in (a, b))
        assert np.any([p == q for p, q in zip(x, y, strict=True)], axis=0).all()


def test_distance_table_never_discards_a_link():
    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    other = fps.copy()
    for _ in range(4):
        other ^= np.int64(1) << rng.integers(0, 63, 500)
    both = np.concatenate([fps, other])
    hit = simhash._near(both, simhash.distance_table(both), np.arange(500), np.arange(500) + 500)
    assert len(hit) == 500


# --- components ------------------------------------------------------------------------------------------------------


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1001) for i in range(50)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1050)} | {2001: 2000}
    assert got == want
    assert cc.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_a_vertex_in_several_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        edges = [(100, v) for v in range(1, 12)] + [(200, v) for v in (50, 60, 70)] + [(201, 60), (201, 10)]
        got = [(r.node, r.root) for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", chunk=2).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == [(v, 1) for v in [*range(2, 12), 50, 60, 70, 100, 200, 201]]
