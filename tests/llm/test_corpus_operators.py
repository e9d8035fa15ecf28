import base64
import hashlib
import math
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import langid, mixing, packing, topk, toxicity, urlfilter, warc


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


# --- toxicity --------------------------------------------------------------------------------------------------------


def toxic_corpus(n=500):
    rng = random.Random(5)
    nice = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("na", "ki", "mo", "ve", "du", "pe")]
    rude = ["blarg", "snork", "grumf"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(nice) for _ in range(rng.randrange(8, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


DOCS = "doc_id long, text string, lang string, score string"
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_learns_and_handles_odd_rows(spark):
    rows, labels = toxic_corpus()
    odd = [(None, "blarg blarg snork blarg", None, None), (9001, None, None, None), (9002, "", None, None), (9003, "x " * 50000, None, None), (3, rows[3][1], None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (7, 1, 0)], LABELS)
    got = toxicity.classify(docs, lab).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (fold(r.doc_id) == 0) and 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert np.mean([p == t for p, t in held]) > 0.95
    kept = toxicity.reject(docs, toxicity.fit(docs, lab))
    assert kept.columns == docs.columns and 9001 in {r.doc_id for r in kept.collect()}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [(r.score, r.predicted) for r in toxicity.classify(docs, none).collect()] == [(0.0, 0)]
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    assert toxicity.classify(docs, one).first().predicted == 0
    assert toxicity.classify(docs.limit(0), one).count() == 0


def test_isotonic_is_monotone_and_exact():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    kx, ky = toxicity.isotonic(x, y, np.ones(5))
    assert ky.tolist() == [0.0, 0.5, 1.0] and kx.tolist() == [1.0, 2.5, 4.5]


def test_disguised_words():
    assert toxicity._plain("1d10t") == "idiot" and toxicity._plain("s.t.u.p.i.d") == "stupid"
    x = dict(zip(toxicity.FEATURES, toxicity.features("you 1d10t, you!!", toxicity.Lexicon({"idiot": 3.0}, {})), strict=True))
    assert x["hidden_density"] > 0 and x["near_second"] > 0 and x["exclamations"] > 0


def brute_features(text, words_odds, stems_odds):
    """The features word by word, in order of the text."""
    raw, words = text.split(), [w for x in text.lower().split() if (w := x.strip(toxicity._EDGE))]
    n, chars = max(1, len(words)), max(1, len(text))
    hits, odds, best, stems, hidden = [], 0.0, 0.0, 0, 0
    for i, w in enumerate(words):
        o, stem, veiled = words_odds.get(w, 0.0), False, False
        for k in toxicity.STEMS:
            if not words_odds.get(w) and len(w) > k and stems_odds.get(w[:k]):
                o, stem = max(o, stems_odds[w[:k]]), True
        p = toxicity._plain(w)
        if not o and not w.isalpha() and p != w and (p in words_odds or p in toxicity.INSULTS):
            o, veiled = words_odds.get(p, 2.0), True
        if o:
            hits.append(i)
            odds, best, stems, hidden = odds + o, max(best, o), stems + stem, hidden + veiled
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    near = sum(any(abs(i - j) <= toxicity.REACH for j in you) for i in hits)
    count = lambda f: sum(map(f, words))
    mixed = {w for w in words if not w.isalpha() and any(c.isalpha() for c in w)}
    return [
        math.log1p(len(words)), math.log1p(len(hits) - stems), (len(hits) - stems) / n, math.log1p(stems), stems / n, odds / n, best, count(lambda w: w in toxicity.INSULTS) / n,
        hidden / n, len(you) / n, near / n, sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text) / chars, sum(x.isupper() and len(x) > 2 for x in raw) / n,
        text.count("!") / n, text.count("?") / n, sum(not (c.isalnum() or c.isspace() or c == "_") for c in text) / chars, sum(len(toxicity._RUN.findall(x)) for x in raw) / n,
        len(mixed) / n, count(len) / n, float(len({words[i] for i in hits})),
    ]


def test_toxicity_features_against_plain_loops():
    rng = random.Random(6)
    some = ["you", "dein", "blarg", "bl4rg", "snorkel", "snorks", "IDIOT!", "st00pid", "s.c.u.m", "--", "x", "Élan", "???", "noooo", "a_b", "YOU,", "…", "ab3"]
    words, stems = {"blarg": 2.5, "snork": 3.0, "scum": 4.0}, {"snor": 2.1, "snork": 2.4}
    for n in (0, 1, 3, 40, 400):
        for _ in range(20):
            text = " ".join(rng.choice(some) for _ in range(n)) + rng.choice(["", "\n", "  !"])
            assert toxicity.features(text, toxicity.Lexicon(words, stems)) == pytest.approx(brute_features(text, words, stems))


def test_toxicity_scores_are_the_calibrated_values():
    m = toxicity.Model(0.1, {"a": 1.0}, toxicity.Trees(), (np.array([-2.0, 0.0, 3.0]), np.array([0.1, 0.4, 0.9])))
    x = np.array([-9.0, -3.0, -2.0, 0.0, 1.5, 3.0, 4.0, 50.0])
    got = m.calibrated(x)
    assert (np.diff(got) > 0).all() and got[2] == 0.1 and got[3] == 0.4 and got[5] == 0.9 and 0 <= got[0] and got[-1] <= 1


# --- language ID -----------------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(2)
    words = {"aa": ["kala", "mala", "tapa", "sana", "paka"], "bb": ["ströf", "grüb", "zwölk", "prünz", "schtö"], "cc": ["uiou", "eiue", "ouie", "ieoo", "aeui"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 40))), lang, "x") for i, lang in zip(range(300), itertools.cycle(words), strict=False)]
    odd = [(900, None, "aa", "x"), (901, "", None, "x"), (902, "12 34 !!", "bb", "x"), (903, "KALA MALA", None, "x"), (None, "kala tapa sana", "aa", "x"), (1, rows[1][1], "bb", "x"), (904, "kala " * 300000, None, "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "aa", "aa", "aa"]
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0.0 <= r.score <= 1.0 for r in got)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_grams_against_plain_counting(monkeypatch):
    def plain(text):
        c = "".join(ch if ch.isalpha() else " " for ch in text.lower())
        words, n = c.split(), {}
        for w in words:
            for k in (1, 2, 3):
                p = w if k == 1 else f" {w} "
                for i in range(len(p) - k + 1):
                    g = p[i : i + k]
                    if g.strip() and " " not in g[1:-1]:
                        n[g] = n.get(g, 0) + 1
        return n

    code = lambda g: sum(ord(ch) << (21 * i) for i, ch in enumerate(g))
    for text in ("", "a", "Ab ba-b, É x", "the the then 3 other ß", "ö" * 50):
        for piece in (1 << 20, 8):
            monkeypatch.setattr(langid, "PIECE", piece)
            grams, counts = langid.gram_counts(text)
            if piece > 100 or " " in text:
                want = {code(g): k for g, k in plain(text).items()}
                if piece > 100:
                    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == want


def test_out_of_place():
    p = np.array([5, 9, 7])
    assert langid.out_of_place(np.array([5, 9, 7]), p, 10) == 0.0
    assert langid.out_of_place(np.array([9, 5]), p, 10) == pytest.approx(0.1)
    assert langid.out_of_place(np.array([1]), p, 10) == 1.0
    t = langid._Profiles({"x": np.array([ord("a"), ord("b")])}, 400)
    assert t.predict("a")[1] == pytest.approx(1 - langid.out_of_place(langid.ranked(*langid.gram_counts("a")), np.array([ord("a"), ord("b")]), 400))


# --- URL filter ------------------------------------------------------------------------------------------------------


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for said, rule in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return host, path, best


URLS = [
    "https://a.example.net/en/1?x=/de/", "http://A.Example.NET/de/1", "https://net/x", "https://net", "https://xnet/", "https://a.org/fr/9#t", "https://a.org/de/9", "https://example.com/de/", "https://example.com/dex",
    "ftp://u@h.org:80/fr/", None, "", "no scheme", "https://", "://net/a://b", "https://sub.b.example.com/de/a?b#c", "https://É.org/fr/x", "https://x.net?/en/", "https://casino.example.com/en/" + "y" * 5000,
]


def test_url_rules_and_verdicts(spark):
    rng = random.Random(4)
    train = [f"https://{rng.choice(['aa', 'bb', 'cc'])}{rng.randrange(99)}.{d}" for d in ["example.net/en/good", "shop.net/bad", "x.org/fr/good", "example.com/de/bad"] for _ in range(60)]
    rows = [(i, u, "x") for i, u in enumerate(URLS + train)] + [(0, URLS[0], "x"), (None, URLS[1], "x")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        host, path, rule = brute_rule(u)
        r = by[i]
        assert (r.host, r.path, r.rule) == (host, path, rule[1] if rule else None), u
        assert r.verdict == rule[0] if rule else r.verdict in ("allow", "block")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_separates(spark):
    good = [f"https://s{i}.example.net/en/article-{i}" for i in range(200)]
    bad = [f"https://s{i}.zz.net/win-cash-now-{i}" for i in range(200)]
    test = [f"https://q{i}.other.com/en/article-{i}" for i in range(20)] + [f"https://q{i}.other.com/win-cash-now-{i}" for i in range(20)]
    rows = [(i, u) for i, u in enumerate(good + bad + test)]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert np.mean([got[400 + i] == ("allow" if i < 20 else "block") for i in range(40)]) > 0.9


def brute_ratio(good, bad):
    """Plain Witten-Bell models of both classes: a function from a url to its mean log ratio."""
    n, order = urlfilter.ALPHABET, urlfilter.ORDER

    def model(urls):
        seen = {}
        for u in urls:
            line = "\x02" * order + u + "\x03"
            for i in range(order, len(line)):
                for k in range(order + 1):
                    c = seen.setdefault(line[i - k : i], {})
                    c[line[i]] = c.get(line[i], 0) + 1

        def p(context, char):
            below = p(context[1:], char) if context else 1 / n
            c = seen.get(context)
            return (c.get(char, 0) + len(c) * below) / (sum(c.values()) + len(c)) if c else below

        return p

    a, b = model(good), model(bad)

    def mean(u):
        line = "\x02" * order + u + "\x03"
        return sum(math.log(a(line[i - order : i], line[i])) - math.log(b(line[i - order : i], line[i])) for i in range(order, len(line))) / (len(u) + 1)

    return mean


def test_url_differences_and_threshold_against_plain_python(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["news", "win", "cash", "é-x", "blog", "p" * 700])
    known = [(s, f"https://{word()}{rng.randrange(50)}.{d}{word()}") for s, d in [("allow", "example.net/en/"), ("block", "shop.net/")] for _ in range(80)]
    asked = ["https://news.com/win", "x", "日本://", "https://cash.com/" + "q" * 3000, "https://blog.example.net/en/"]
    counts = urlfilter.gram_counts(spark.createDataFrame(known, "said string, url string"))
    rows = spark.createDataFrame(list(enumerate(asked)), "u long, url string")
    ratios = urlfilter.log_ratios(counts, rows.select(F.explode(urlfilter.grams(F.col("url"))).alias("gram")))
    got = {r.u: r.difference for r in urlfilter.differences(rows, ratios).collect()}
    mean = brute_ratio([u for s, u in known if s == "allow"], [u for s, u in known if s == "block"])
    assert got == {i: pytest.approx(mean(u), abs=1e-9) for i, u in enumerate(asked)}
    scores = [("allow", 0.5), ("allow", 0.2), ("allow", -0.4), ("block", 0.1), ("block", -0.5), ("block", -0.6)]
    cut = urlfilter.threshold(spark.createDataFrame(scores, "said string, difference double"))
    assert 0.1 < cut < 0.2 or -0.5 < cut <= -0.4
    assert urlfilter.threshold(spark.createDataFrame(scores[:3], "said string, difference double")) == 0.0


def test_url_filter_with_one_class_or_none(spark):
    only = lambda urls: {r.verdict for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect() if r.rule is None}
    assert only(["https://a.com/", None, ""]) == {"allow"}
    assert only([f"https://{k}.net/" for k in range(30)] + ["https://a.com/"]) == {"block"}
    assert only([f"https://{k}.org/fr/" for k in range(30)] + ["https://a.com/", None]) == {"allow"}


# --- WARC ------------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, "é"), (4, "http://c/\r\nX: y", None), (5, "http://d/", ""), (6, "http://e/", "big " * 40000), (6, "http://e/", "big " * 40000), (None, "http://n/", "lone"), (None, "http://n/", "<p>x</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    path = f"file://{tmp_path}/archive"
    got = warc.archive_round_trip(df, path, least).collect()
    assert len(got) == len(PAGES)
    body = lambda h: (h or "").encode()
    best = {}
    for i, _, h in PAGES:
        best[body(h)] = max([x for x in (best.get(body(h)), i) if x is not None], default=None)
    want = []
    for i, _, h in PAGES:
        b = body(h)
        response = len(b) < least or i == best[b]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else best[b]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    records = warc.read_records(spark, path).collect()
    assert len(records) == len(PAGES)
    assert sorted(bytes(r.body) for r in records if r.record_type == "response") == sorted(body(h) for (_, _, h), w in zip(PAGES, want, strict=True) if w[3] == "response")
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert rest == bytes(r.body) + b"\r\n\r\n" and int(lines[b"Content-Length"]) == len(rest) - 4
        assert lines[b"WARC-Record-ID"] == (b"<urn:page>" if r.page_id is None else b"<urn:page:%d>" % r.page_id)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len(best)  # bytes once, repeated rows included


@pytest.mark.parametrize(("old", "new"), [("WARC-Type: revisit", "WARC-Type: nothing"), ("Content-Length: 8", "Content-Length: 9"), ("sha1:", "sha1:A")])
def test_warc_reads_its_headers(spark, tmp_path, old, new):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    headers = [(bytes(r.sha256), bytes(r.header).decode().replace(old, new).encode()) for r in spark.read.parquet(f"{path}/headers").collect()]
    spark.createDataFrame(headers, "sha256 binary, header binary").write.mode("overwrite").parquet(f"{path}/headers")
    with pytest.raises(Exception, match="header does not fit|digest line"):
        warc.read_digests(spark, path).collect()


def test_warc_checks_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    bad = spark.createDataFrame([(bytes(r.sha256), bytes(r.payload) + b"!") for r in spark.read.parquet(f"{path}/payloads").collect()], "sha256 binary, payload binary")
    bad.write.mode("overwrite").parquet(f"{path}/payloads")
    spark.createDataFrame([(1,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")
    with pytest.raises(Exception, match="does not match its digest|bucket"):
        warc.read_digests(spark, path).collect()


def test_warc_empty(spark, tmp_path):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e").count() == 0


# --- top-k -----------------------------------------------------------------------------------------------------------


def brute_top(rows, queries, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi in sorted({i for i in queries}):
        own = min((v for i, v in ok if i == qi), default=None)
        if own is None:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in ok if i != qi))[:k]
        out += [(qi, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("segment", [topk.SEGMENT, 16])
def test_top_k_is_exact(spark, monkeypatch, segment):
    monkeypatch.setattr(topk, "SEGMENT", segment)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(segment)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(260)]
    rows += [(300 + i, rows[7][1]) for i in range(90)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, [1.0] * 8), (50, rows[50][1]), (700, []), (750, [30000.0] * 8), (751, [-0.001] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == brute_top(rows, [i for i, _ in rows if i is not None and i % 50 == 0])
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_prunes_where_vectors_cluster(spark):
    """20,000 vectors around 40 centres: the triangle inequality excludes most of the pairs, and the result stays exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = centres[rng.integers(0, 40, 20_000)] + rng.normal(scale=0.02, size=(20_000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found, share = topk.search(df, segment=256)
    assert share < 0.3
    ints = np.floor(256 * x).astype(np.int64)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert len(got) == 400
    for q in range(0, 20_000, 50):
        s = ints @ ints[q]
        s[q] = -(2**60)
        want = np.lexsort((np.arange(len(s)), -s))[:5]
        assert sorted(got[q]) == [(n, -int(s[i]), int(i)) for n, i in enumerate(want, 1)]


def test_top_k_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 512)]


# --- packing ---------------------------------------------------------------------------------------------------------


def brute_pack(lengths, sources, clusters, capacity, per):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and b["s"].count(s) < per and c not in b["c"]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": [], "c": set()})
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= n
        bins[k]["s"].append(s)
        bins[k]["c"].add(c)
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(6)
    for per in (1, 2, 4):
        for _ in range(30):
            n = rng.randrange(1, 80)
            lengths = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
            s, c = [rng.randrange(4) for _ in range(n)], [rng.randrange(1 + n // 2) for _ in range(n)]
            assert packing.best_fit(lengths, s, c, 100, per) == brute_pack(lengths, s, c, 100, per)


def test_pack_covers_everything(spark):
    rng = random.Random(8)
    texts = ["w " * rng.randrange(0, 300) for _ in range(120)] + ["same text here"] * 30 + [None, "", "w " * 1000, "W " * 1000]
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 3}") for i, t in enumerate(texts)] + [(5, texts[5], "s2"), (5, texts[5], "s2"), (None, "null id", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit("clash"))
    got = packing.pack(df, capacity=256, per_source=2, shard=40).collect()
    size = {}
    for r in got:
        if r.bin is not None:
            size.setdefault((r["shard"], r["bin"]), []).append(r)
    for members in size.values():
        members.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in members:
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= 256
        own = [texts[r.doc_id].lower() if r.doc_id is not None else "n" for r in members]
        assert len(set(own)) == len(own)
    per_row = {}
    for r in got:
        per_row.setdefault((r.doc_id, r.copy), []).append((r.start, r.n_tokens))
    assert len(per_row) == len(rows)
    for (i, _), parts in per_row.items():
        want = len((texts[i] or "").split()) if i is not None else 2
        assert sum(n for _, n in parts) == want and [s for s, _ in sorted(parts)] == list(range(0, max(1, want), 256))[: len(parts)]
    assert packing.pack(df.limit(0)).count() == 0


def test_part_filled_bins_of_shards_meet(spark):
    """Odd sizes leave every shard a part-filled bin or more; packed on, about one shard's remain."""
    rng = random.Random(12)
    rows = [(i, " ".join([f"w{i}"] + ["x"] * rng.randrange(20, 120)), f"s{i % 50}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fill = lambda **k: packing.pack(df, capacity=256, per_source=4, shard=40, **k).groupBy("shard", "bin").sum("n_tokens").count()
    tokens = sum(len(t.split()) for _, t, _ in rows)
    on, once = fill(), fill(closed=0.0)
    assert tokens / 256 <= on < once
    near = df.select("doc_id", (F.col("doc_id") % 300).alias("c"))
    got = packing.pack(df, capacity=256, shard=400, clusters=near).collect()
    held = {}
    for r in got:
        held.setdefault((r["shard"], r["bin"]), []).append(r.doc_id % 300)
    assert len(got) == 1200 and all(len(set(v)) == len(v) for v in held.values())


# --- mixing ----------------------------------------------------------------------------------------------------------


def brute_mix(docs, sample, names, targets, evidence):
    """Plain naive Bayes over words and plain projected gradient: (posteriors, rates). sample: (domain, text) to learn from."""
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    counts = {d: {} for d in names}
    for d, t in sample:
        for w in words(t):
            counts[d][w] = counts[d].get(w, 0) + 1
    total = {d: sum(c.values()) + 0.5 * mixing.BUCKETS for d, c in counts.items()}
    prior = {d: math.log(sum(x == d for x, _ in evidence[1]) / len(evidence[1])) for d in names}
    p, n = [], []
    for t in docs:
        w = words(t)
        mean = [sum(math.log((counts[d].get(x, 0) + 0.5) / total[d]) for x in w) / max(1, len(w)) for d in names]
        logs = np.array([prior[d] + m * min(len(w), evidence[0]) for d, m in zip(names, mean, strict=True)])
        e = np.exp(logs - logs.max())
        p.append(e / e.sum())
        n.append(len(w))
    p, w = np.array(p), np.array(n) / sum(n)
    target = np.array([targets.get(d, 0.0) for d in names])
    target, share, r = target / target.sum(), w @ p, np.ones(len(docs))
    for _ in range(400):
        r = np.maximum(0.0, r - p @ (((w * r) @ p - target) / share))
    return p, r


def mixing_rows():
    words = {"en": "the thing with the other thing", "de": "schein auf die einung ich", "fr": "que eau leurs eaux que ouest", "es": "los ados con tanto sol"}
    rows = [(i, (words[lang] + " ") * (1 + i % 5), lang) for i, lang in zip(range(200), itertools.cycle(["en", "en", "en", "de", "fr", "es"]), strict=False)]
    rows += [(900, None, "en"), (901, "", None), (902, "zzz", None), (903, "the que auf los", "en"), (904, "The\tthing " * 60_000, "en"), (None, "ich auf", None), (3, rows[3][1], "de")]
    return rows


def test_mixing_against_plain_python(spark):
    rows, targets = mixing_rows(), {"en": 1, "de": 1, "fr": 1, "es": 1}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rate", F.lit("clash"))
    labelled = df.filter("doc_id % 7 < 4 and doc_id < 900 and lang is not null").select("doc_id", "lang")
    sample = mixing.sampled(df, labelled, "doc_id", "text", "lang")
    model = mixing.fit_classifier(sample)
    assert model.names == ["de", "en", "es", "fr"] and model.evidence in mixing.EVIDENCE
    features = {t: tuple(x) for t, x in df.select("text", mixing.features(F.col("text")).alias("x")).collect()}
    learned = [(r.domain, t) for r in sample.filter("not held").collect() for t in [next(t for t, x in features.items() if x == tuple(r.x))]]
    every = [(r.domain, 0) for r in sample.select("domain").collect()]
    p, rate = brute_mix([t for _, t, _ in rows], learned, model.names, targets, (model.evidence, every))
    got = mixing.mix(df, labelled, targets).collect()
    want = sorted((str(i), len((t or "").split()), np.round(x, 4).tolist(), round(r, 2)) for (i, t, _), x, r in zip(rows, p, rate, strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, np.round([r.posterior[d] for d in model.names], 4).tolist(), round(r.rate, 2)) for r in got) == want


def test_rates_meet_targets(spark):
    rows, targets = mixing_rows(), {"en": 1, "de": 1, "fr": 1, "es": 1}
    df = spark.createDataFrame([r for r in rows if r[0] != 904], "doc_id long, text string, lang string").withColumn("rate", F.lit("clash"))
    labelled = df.filter("doc_id % 7 < 4 and lang is not null").select("doc_id", "lang")
    got = mixing.mix(df, labelled, targets).collect()
    assert len(got) == len(rows) - 1 and all(r.rate >= 0 for r in got) and min(r.rate for r in got) < 0.9
    total = sum(r.n_tokens for r in got)
    for d in targets:
        assert sum(r.rate * r.n_tokens * r.posterior[d] for r in got) == pytest.approx(total / 4, rel=1e-3)
    up = mixing.mixed(df, labelled, targets)
    assert up.columns == df.columns
    counts = {r.doc_id: r["n"] for r in up.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(math.floor(r.rate) <= counts.get(r.doc_id, 0) / (2 if r.doc_id == 3 else 1) <= math.ceil(r.rate) for r in got)


def test_mixing_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = df.limit(0).select("doc_id", "lang")
    assert [(r.n_tokens, r.rate) for r in mixing.mix(df, none).collect()] == [(2, 1.0)]
    assert mixing.mix(df.limit(0), none).count() == 0
    assert mixing.mixed(df, none).count() == 1


def test_projection_to_the_least_rate(spark):
    rows = [(1, "the thing the thing", "en"), (2, "que eau que eau", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in mixing.mix(df, df.select("doc_id", "lang"), {"fr": 1.0}).collect()}
    # all is asked of one domain: the other document is given up, and this one's rate is the least-squares optimum
    p, q = got[2].posterior, got[1].posterior
    share = {d: (p[d] + q[d]) / 2 for d in p}
    best = (0.5 * p["fr"] / share["fr"]) / sum((0.5 * p[d]) ** 2 / share[d] for d in p)
    assert got[1].rate == pytest.approx(0.0, abs=1e-2) and got[2].rate == pytest.approx(best, rel=1e-2)
