import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_dedup import lower
from test_corpus_operators import toxic_corpus

from foliomill.llm import mixing, nearcopies, toxicity
from foliomill.llm.common import table
from foliomill.llm.queries import labelled_domains


def fixture(tmp_path, spark):
    rng = random.Random(11)
    rows, labels = toxic_corpus(320)
    docs = [(i, t, lang, f"s{i % 5}" if i % 3 else "hot", len(t)) for i, t, lang, _ in rows]
    clean = [d for d in docs if d[0] % 4]
    docs += [(1000 + k, d[1].upper() if k % 2 else d[1], "en", "hot", d[4]) for k, d in enumerate(clean[:40])]
    long = " ".join(rng.choice("mina kivo rapa sudu tepe".split()) + str(rng.randrange(30)) for _ in range(500))
    docs += [(2000 + k, long.replace(long.split()[100 * k + 7], "changed", 1), "de", "hot", len(long)) for k in range(4)]
    docs += [(3000, None, None, None, None), (3001, "", "fr", "s1", 0), (3002, "que eau leurs", "fr", "s1", 13), (5, docs[5][1], "en", "x", 1)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels + [(3002, 1, 0), (2000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def near_groups(texts):
    """{id: smallest id of its component}, by all pairs of five-word shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = lower(t).split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root, ids = {i: i for i in texts}, sorted(texts)
    for x in ids:
        for y in ids:
            if y < x and root[x] != root[y] and (sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])):
                a, b = root[x], root[y]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


def test_stages_against_plain_python(spark, tmp_path):
    path = fixture(tmp_path, spark)
    docs = table(spark, path, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]

    kept = stages["toxicity"](spark, docs, path).cache()
    assert kept.columns == columns
    scored = toxicity.classify(docs, table(spark, path, "labels")).filter("predicted = 0")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scored.collect())

    once = stages["exact dedup"](spark, kept, path).cache()
    best = {}
    for r in kept.collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(best.values())

    apart = stages["SimHash near-dedup"](spark, once, path).cache()
    least = near_groups({r.doc_id: r.text for r in once.collect()})
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted(set(least.values())) and len(set(least.values())) < once.count()

    mixed = stages["mixing to target weights"](spark, apart, path).cache()
    rates = {r.doc_id: r.rate for r in mixing.mix(apart, labelled_domains(apart, table(spark, path, "labels"))).collect()}
    uses = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(uses) <= set(least.values()) and all(int(r) <= uses[i] <= int(r) + 1 for i, r in rates.items())

    packed = stages["best-fit packing"](spark, mixed, path).collect()
    tokens = {r.doc_id: len((r.text or "").split()) for r in apart.collect()}
    copies = {}
    for r in packed:
        copies.setdefault((r.doc_id, r.copy), []).append(r.n_tokens)
    assert len(copies) == mixed.count() and all(sum(n) == tokens[i] for (i, _), n in copies.items())


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("limit", [nearcopies.LIST_LIMIT, 3])
def test_near_copies_against_all_pairs_of_five_word_shingles(spark, limit):
    rng = random.Random(23)
    texts = [" ".join(rng.choice(["pa", "ke", "li"]) + str(rng.randrange(400)) for _ in range(rng.randrange(3, 500))) for _ in range(60)]
    for base in texts[:40]:
        for _ in range(4):
            words = base.split()
            for _ in range(rng.randrange(1, 3 + len(words) // 30)):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(1000))
            texts.append(" ".join(words))
    texts += [None, "", "one two", "One  TWO", texts[3].upper()]
    root = near_groups(dict(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = nearcopies.drop_near_copies(docs, limit=limit)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.values())) and len(set(root.values())) < len(texts) - 40


@pytest.mark.parametrize("limit", [nearcopies.LIST_LIMIT, 3])
def test_rows_of_a_near_copy_group_grow_with_its_sets(spark, monkeypatch, limit):
    rng, made, settle = random.Random(5), [], nearcopies.settle
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(160):  # links within the group, and 40 texts that nearly link
        words = list(base)
        for at in rng.sample(range(120), 1 if k < 120 else 2):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))

    def counted(df, what="table"):
        out = settle(df, what)
        made.append((what, out.count()))
        return out

    monkeypatch.setattr(nearcopies, "settle", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in nearcopies.drop_near_copies(docs, limit=limit).collect())
    assert got == sorted(set(near_groups(dict(enumerate(texts))).values())) and len(got) < 60
    assert all(n <= 4 * len(texts) for _, n in made), made  # met: at most a row a set and a task


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{i % 9000}" for i in range(20_000))
    rows = [(1, long, "a"), (2, long + " more", "b"), (None, long, "n"), (None, "lone text of six words here", "n"), (5, None, "x"), (6, "", "x"), (7, "x y", "y"), (7, "x  Y", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, best string")
    got = nearcopies.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, [1, None, None, 5, 7, 7]))
    assert nearcopies.drop_near_copies(df.limit(0)).count() == 0


def test_near_copies_meet_by_their_fingerprints_only(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "other"])]
    bits = nearcopies.KEY_BITS
    tables = nearcopies.table_counts(bits, nearcopies.SIMILARITY)
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    sims = [nearcopies.simhash_bits(s, -(-int(tables[-1]) * bits // 64)) for s in sets]
    sims[2] = bytes(255 - x for x in sims[2])  # the same shingles, but no bit in common
    rows = [(i, nearcopies.key_of(s), len(s), sim) for i, (s, sim) in enumerate(zip(sets, sims, strict=True))]
    docs = spark.createDataFrame(list(enumerate(texts)), "_fm_id long, _fm_text string")
    facts = spark.createDataFrame(rows, "_fm_id long, key long, size long, sim binary")
    assert {frozenset(r) for r in nearcopies.links(docs, facts).collect()} == {frozenset((rows[0][1], rows[1][1]))}


def test_simhash_bits_against_plain_counting():
    rng, mask = random.Random(3), (1 << 64) - 1
    for n in (0, 1, 2, 5, 254, 255, 256, 700):
        hashes = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)})
        expected = b""
        for word in range(1, 4):
            ones = [0] * 64
            for h in hashes:
                x = (h + word * 0x9E3779B97F4A7C15) & mask
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
                x = (x ^ (x >> 31)).to_bytes(8, "little")
                for k in range(64):
                    ones[k] += x[k // 8] >> (7 - k % 8) & 1
            expected += int("".join("1" if 2 * k > n else "0" for k in ones), 2).to_bytes(8, "big")
        assert nearcopies.simhash_bits(np.array(hashes, dtype=np.int64), 3) == expected


@pytest.mark.parametrize("a, b, c", [(4, 5, 4), (12, 15, 12), (36, 36, 32), (450, 450, 400)])
def test_pairs_at_the_least_similarity_meet(a, b, c):
    rng, bits = np.random.default_rng(a), nearcopies.KEY_BITS
    tables = nearcopies.table_counts(bits, 0.8)
    q = nearcopies.differs(0.8)[min(a, nearcopies.SMALL)]
    own, apart = min(int(tables[min(n, nearcopies.SMALL)]) for n in (a, b)), 0
    for _ in range(60):
        h = rng.integers(-(1 << 63), (1 << 63) - 1, a + b - c, dtype=np.int64)
        x, y = (np.frombuffer(nearcopies.simhash_bits(s, own * bits // 64 + 1), dtype=np.uint8) for s in (h[:a], h[a - c :]))
        apart += float(np.unpackbits(x ^ y).mean())
        met = (x ^ y)[: own * bits // 8].reshape(own, bits // 8)
        assert (met == 0).all(axis=1).any()
    assert apart / 60 < q + 0.01
