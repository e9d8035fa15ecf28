import hashlib
import random

import pytest

from foliomill.llm import suffixdedup as m


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_array_is_sorted(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 90] * 12:
        s = [rng.randrange(letters) for _ in range(n)]
        assert m.suffix_array(s) == sorted(range(n), key=lambda i: s[i:])


def test_suffix_array_on_hard_strings():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a  # Fibonacci
    for s in (b, [1] * 60, [0, 1] * 40, [1, 0] * 40, list(range(50)), list(range(50))[::-1], [-3, 5, -3, 5, 2]):
        assert m.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for k, t in enumerate(bodies):
        for i in range(len(t) - m.WINDOW + 1):
            seen.setdefault(t[i : i + m.WINDOW], []).append((k, i))
    gone = [bytearray(len(t)) for t in bodies]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + m.WINDOW] = b"\1" * m.WINDOW
    out = []
    for t, g in zip(bodies, gone, strict=True):
        runs = sum(1 for i in range(len(g)) if g[i] and (not i or not g[i - 1]))
        kept = bytes(x for x, y in zip(t, g, strict=True) if not y)
        out.append((len(t), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    p, q, long = prose(90), prose(100), prose(400)
    texts = [prose(rng.randrange(1, 300)) for _ in range(12)]
    texts += [prose(50) + p + prose(40), prose(30) + p + prose(60), p, p[:420], "x" + p[:399], prose(3) + p + q, q + p, prose(20) + q[:401] + prose(9)]
    texts += [long, long, long[:900] + "Z" + long[901:], long[100:1300], "Y" + long[1:], None, "", "short", "short"]
    texts += ["ab" * 500, "ab" * 230, "a" * 450, "a" * 401, "a" * 400, p + p, prose(10) + p[5:405] + "é" + p[100:600]]
    return texts


def rows_of(spark, texts, limit=m.GROUP_LIMIT):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, did string")
    return [tuple(r)[1:] for r in m.remove_repeats(df, group_limit=limit).orderBy("doc_id").collect()]


@pytest.mark.parametrize("limit", [m.GROUP_LIMIT, 2])
def test_against_brute_force(spark, limit):
    texts = corpus(limit)
    assert rows_of(spark, texts, limit) == brute(texts)


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(m, "SEGMENT", 1500)
    monkeypatch.setattr(m, "_tables", {})
    texts = corpus(7)
    bodies = [(i, 1, (t or "").encode()) for i, t in enumerate(texts)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*bodies, strict=True)], ["did", "tx", "body"])
    windows = set()
    for b in m._anchors(iter([batch])):
        for d, pos in zip(b.column("did").to_pylist(), b.column("pos").to_pylist(), strict=True):
            start, last = pos >> 20, pos & 1023
            for i in range(start, start + last + 1):
                assert (d, i) not in windows
                windows.add((d, i))
    assert windows == {(d, i) for d, _, t in bodies for i in range(len(t) - m.WINDOW + 1)}


def test_repeated_and_null_ids(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(500))
    df = spark.createDataFrame([(1, t), (1, t), (None, "n" + t[:420]), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in m.remove_repeats(df).collect())
    assert got == [(0, 421, 420), (1, 500, 500), (1, 500, 500), (2, 0, 0)]
    assert m.remove_repeats(df.limit(0)).count() == 0
    assert {r.doc_id: len(r.kept) for r in m.kept_bytes(df).collect()}[None] == 1


def test_large_group_and_many_identical_rows(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, same = noise(450), noise(600)
    texts = [noise(rng.randrange(80)) + passage[: rng.choice([450, 450, 430, 405])] + noise(rng.randrange(80)) for _ in range(m.GROUP_LIMIT + 60)]
    assert rows_of(spark, texts) == brute(texts)
    df = spark.createDataFrame([(7, same)] * 100 + [(8, noise(500))], "doc_id long, text string")
    spans = m.spans_by_row(m._identified(df, "doc_id", "text")).collect()
    assert len(spans) == 1 and len(spans[0].spans) <= 5
    assert sorted({(r.doc_id, r.n_removed, r.n_spans) for r in m.remove_repeats(df).collect()}) == [(7, 600, 1), (8, 0, 0)]
