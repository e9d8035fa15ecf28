"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of learned lexicons (whole words and word stems with their log-odds) and of a
small built-in one, how close they stand to second-person words, capitals, punctuation and obfuscation rates.

Learning uses only labelled rows outside fold 0 and a bounded sample of them: at most SAMPLE rows a class, the
smallest hash in each hash bucket; the lexicons are all terms of that sample that pass two thresholds. It is split in three by another hash: lexicons are learned on the first part,
trees are grown on the second, the calibration is fitted on the third, so that no part judges words or margins it
has seen. A score is the calibrated value itself, beyond the outermost knots with a tail that keeps the order of margins.
Sampled rows carry the weight of their class, so scores stay probabilities of the whole table. Labels,
lang, source and ids are never inputs of a score. Scoring is one map over the documents, without a shuffle.

Defined results: null and empty texts are scored like any other (all densities zero). Labels that are null are not
learned from; of several labels for an id the largest counts. With no label, or one class only, every score is the
smoothed share of toxic labels. Very long texts count whole: each distinct word is judged once. Columns other than id
and text, whatever their names, are ignored by score and kept by reject. A null id is held out. Repeated rows are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, settle

SAMPLE = 6000
CACHED = 50_000  # distinct words whose judgement a worker keeps
STEMS = (4, 5, 6)
REACH = 5

# A few common insults, and second-person words of some languages.
INSULTS = frozenset("idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown fool ugly hate filthy vermin".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…|/\\-–—_*#"
_NOT_WORD = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[^\w\s]")

FEATURES = (
    "log_words", "log_hits", "hit_density", "log_stem_hits", "stem_density", "log_odds_density", "best_log_odds", "builtin_density",
    "hidden_density", "second_density", "near_second", "capitals", "capital_words", "exclamations", "questions", "marks", "runs",
    "mixed_words", "word_length", "distinct_hits",
)


def _plain(word: str) -> str:
    """A word without disguise: look-alike digits and signs as letters, other marks and drawn-out letters gone."""
    return _RUN.sub(r"\1", _NOT_WORD.sub("", word.translate(_LEET)))


def tokens(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(_EDGE))]


def terms(text: str) -> set[str]:
    """What a lexicon may hold: the distinct words of a text, and their stems marked with a tilde."""
    words = set(tokens(text))
    return words | {w[:n] + "~" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """Words and stems with their log-odds, and what they say of a word; judged words are kept, up to a bound."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self._judged = words, stems, {}

    def judge(self, raw: str) -> tuple:
        """What a word says as it stands: plain word, log-odds (0: no hit), by a stem, in disguise, built-in insult, second
        person, letters and other signs mixed, capitals, all capitals, marks, drawn-out runs."""
        got = self._judged.get(raw)
        if got is None:
            w, odds, stem, veiled = raw.lower().strip(_EDGE), 0.0, False, False
            if w:
                odds = self.words.get(w, 0.0)
                if not odds:
                    odds = max([self.stems.get(w[:k], 0.0) for k in STEMS if len(w) > k], default=0.0)
                    stem = odds > 0
                if not odds and not w.isalpha():
                    p = _plain(w)
                    if p != w and (p in self.words or p in INSULTS):
                        odds, veiled = self.words.get(p, 2.0), True
            mixed = bool(w) and not w.isalpha() and any(c.isalpha() for c in w)
            signs = len(_UPPER.findall(raw)), len(raw) > 2 and raw.isupper(), len(_MARK.findall(raw)), len(_RUN.findall(raw))
            got = w, odds, stem, veiled, w in INSULTS, w in SECOND, mixed, *signs
            if len(self._judged) < CACHED:
                self._judged[raw] = got
        return got

    def __getstate__(self):
        return self.words, self.stems

    def __setstate__(self, state):
        self.__init__(*state)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of a whole text: each distinct word is judged once, and counts do the rest."""
    raw = text.split()
    words = hits = stem_hits = builtin = hidden = seconds = letters = capitals = shouted = marks = runs = 0
    odds = best = 0.0
    mixed, seen, flags = set(), set(), {}
    for x, k in Counter(raw).items():
        w, o, stem, veiled, known, second, mix, upper, capital, mark, run = lexicon.judge(x)
        flags[x] = (4 if w else 0) | (2 if second else 0) | (1 if o else 0)
        capitals += k * upper
        shouted += k * capital
        marks += k * mark
        runs += k * run
        if not w:
            continue
        words += k
        letters += k * len(w)
        builtin += k * known
        seconds += k * second
        if mix:
            mixed.add(w)
        if o:
            hits += k
            odds += k * o
            best = max(best, o)
            stem_hits += k * stem
            hidden += k * veiled
            seen.add(w)
    near = 0.0
    if seconds and hits:
        at = np.array([flags[x] for x in raw])
        at = at[at > 0]
        you, hit = np.flatnonzero(at & 2), np.flatnonzero(at & 1)
        i = np.searchsorted(you, hit)
        ends = np.array([-(10**9), *you, 10**9])
        near = float((np.minimum(np.abs(ends[i + 1] - hit), np.abs(ends[i] - hit)) <= REACH).sum())
    n, chars = max(1, words), max(1, len(text))
    return [
        math.log1p(words), math.log1p(hits - stem_hits), (hits - stem_hits) / n, math.log1p(stem_hits), stem_hits / n, odds / n, best, builtin / n,
        hidden / n, seconds / n, near / n, capitals / chars, shouted / n,
        text.count("!") / n, text.count("?") / n, marks / chars, runs / n,
        len(mixed) / n, letters / n, float(len(seen)),
    ]


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base, self.trees, self.edges = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
        self.base = math.log(p / (1 - p))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(b, w * (q - y), w * np.maximum(q * (1 - q), 1e-6))
            self.trees.append(tree)
            margin += self._walk(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        node = np.zeros(len(g), dtype=np.int64)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = -self.rate * gs / (hs + self.l2) if len(rows) else 0.0
            if at >= 2**self.depth - 1 or not len(rows):
                continue
            gain, best = 1e-6, None
            for k in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[rows, k], weights=g[rows], minlength=self.bins + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, k], weights=h[rows], minlength=self.bins + 1))[:-1]
                score = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                score[(hl < self.least * 0.05) | (hs - hl < self.least * 0.05)] = 0
                if score.max() > gain:
                    gain, best = score.max(), (k, int(score.argmax()))
            if best:
                feature[at], cut[at] = best
                node[rows] = 2 * at + 1 + (b[rows, best[0]] > best[1])
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[node]
            down = 2 * node + 1 + (b[rows, np.maximum(f, 0)] > cut[node])
            node = np.where(f >= 0, down, node)
        return value[node]

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, m = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            m += self._walk(tree, b)
        return m


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a nondecreasing map from margin to probability."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([wi, wi * yi, wi * xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


class Model:
    """Lexicons, trees and calibration: small, and sent with the tasks."""

    def __init__(self, base: float, odds: dict[str, float] | None = None, trees: Trees | None = None, knots: tuple[np.ndarray, np.ndarray] | None = None):
        odds = odds or {}
        self.base, self.trees, self.knots = base, trees, knots
        self.lexicon = Lexicon({t: o for t, o in odds.items() if not t.endswith("~")}, {t[:-1]: o for t, o in odds.items() if t.endswith("~")})

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([features(t or "", self.lexicon) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.base)
        return self.calibrated(self.trees.margins(self.matrix(texts)))

    def calibrated(self, m: np.ndarray) -> np.ndarray:
        """The isotonic map between its knots; below and above them, tails towards 0 and 1."""
        x, y = self.knots
        if not len(x):
            return np.full(len(m), self.base)
        p = np.interp(m, x, y)
        p = np.where(m < x[0], y[0] * np.exp(np.minimum(0.0, m - x[0])), p)
        return np.where(m > x[-1], 1 - (1 - y[-1]) * np.exp(np.minimum(0.0, x[-1] - m)), p)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """(part, y, text) of the sampled rows, and the weight of each class."""
    own = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y"), fold(id_col).alias("f"))
    own = own.filter("f <> 0 and y is not null and l_id is not null").groupBy("l_id").agg(F.max("y").alias("y"))
    own = own.withColumn("h", F.xxhash64("l_id", F.lit("toxicity")))
    chosen = own.groupBy("y", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min(F.struct("h", "l_id")).alias("best"), F.count(F.lit(1)).alias("n"))
    chosen = settle(chosen.select("y", F.col("best.l_id").alias("l_id"), F.pmod(F.shiftright("best.h", 20), F.lit(5)).alias("draw"), "n"), "sample")
    weight = {int(r.y): r.n / r.k for r in chosen.groupBy("y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    part = F.when(F.col("draw") < 2, 0).when(F.col("draw") < 4, 1).otherwise(2)
    # at most sample rows a class: bounded by the parameter, whatever the tables' sizes
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select(part.alias("part"), (F.col("y") > 0).cast("int").alias("y"), "text")
    return found, weight


def _learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems of the first part with surprisingly many toxic documents, and their smoothed log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[y].update(terms(text or ""))
            both = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({"term": both, "n0": [counts[0][t] for t in both], "n1": [counts[1][t] for t in both]}, schema=pa.schema([("term", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())]))

    total = {r.y: r.n for r in rows.filter("part = 0").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = float(total.get(1, 0)), float(total.get(0, 0))
    if not a or not b:
        return {}
    counted = rows.filter("part = 0").select("y", "text").mapInArrow(run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (a + 1)) - F.log((F.col("n0") + 0.5) / (b + 1))
    expected = (F.col("n0") + F.col("n1")) * (a / (a + b))
    surprise = 2 * F.col("n1") * F.log(F.col("n1") / expected)
    picked = counted.filter("n1 >= 2").select("term", odds.alias("odds"), surprise.alias("g")).filter("odds >= 2 and g >= 7")  # bounded by the sample
    return {r.term: float(r.odds) for r in picked.collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    rows, weight = labelled_sample(docs, labels, id_col, text_col, label_col, sample)
    rows = settle(rows, "labelled")
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    mass = {y: total.get(y, 0) * weight.get(y, 1.0) for y in (0, 1)}
    base = (mass[1] + 0.5) / (mass[0] + mass[1] + 1.0) if sum(mass.values()) else 0.0
    if not total.get(0) or not total.get(1):
        return Model(base)
    model = Model(base, _learn_lexicon(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["part", "y", "x"])

    got = rows.filter("part > 0").mapInArrow(run, "part int, y int, x array<double>").collect()  # bounded: at most two samples
    part, y = np.array([r.part for r in got]), np.array([r.y for r in got], dtype=np.float64)
    x = np.array([r.x for r in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    w = np.where(y > 0, weight.get(1, 1.0), weight.get(0, 1.0))
    grow, hold = part == 1, part == 2
    if len(set(y[grow])) < 2:
        return Model(base)
    if len(set(y[hold])) < 2:
        hold = grow
    model.trees = Trees().fit(x[grow], y[grow], w[grow])
    model.knots = isotonic(model.trees.margins(x[hold]), y[hold], w[hold])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).alias("id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside fold 0, then score every document."""
    return score(docs, fit(docs, labels))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(text_col).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
