"""Mixing sources to target weights: soft membership and projected-gradient rates, in DataFrame functions only.

1. A labelled table trains a classifier: multinomial naive Bayes over hashed words (BUCKETS features, learned, not
   listed). It is fitted on a bounded sample, at most SAMPLE labelled rows a domain (the smallest hash of each bucket);
   its statistics are one grouped count. A document's evidence is its mean log-likelihood a word, times at most as many
   words as calibrate best: of EVIDENCE the value with the least log loss on the fourth of the sample kept back.
2. Every document gets its posterior p over the domains from its whole text.
3. Rates low <= r <= high are fitted by projected gradient on the least squares
      sum over domains of (sum_i w_i r_i p_id - target_d)^2 / (2 s_d),   w_i = tokens_i / all tokens,
   with s_d the expected share of domain d at rate 1. Scaled so, the largest curvature is 1 and the step is 1:
      r_i <- min(high, max(low, r_i - sum_d p_id residual_d / s_d)).
   A round is one aggregation of as many sums as there are domains over the compact table (tokens, posterior, rate);
   only those sums reach the driver, and go back into the plan as literals. The table is written every few rounds.

A rate is an expected number of uses, 0 or more. mixed() applies it: the whole part for everyone, one more for a share
of the documents equal to the rest, drawn by a hash of the id. Documents of domains above their target are thinned,
others repeated; the expected number of tokens is total times what it was (1: unchanged).

Skew: nothing is grouped by document, source or domain but the class counts, which are partially aggregated.

Defined results: null, empty and word-free texts have no token and no evidence, so their posterior is the prior and
their rate is fitted like any other. Very long texts count whole. Labelled rows without an id or a domain are left out;
an id with several domains counts for each. Of equal posteriors the domain that sorts first is named. A domain without a
target has target 0; a target without a labelled row cannot be met and is left out, and the rest are scaled to sum to
1. With no labelled row or no token every rate is 1 and posteriors are empty. Repeated rows get a rate each; a null id
is drawn like one id. An empty table gives no rows. Other columns, whatever their names, are ignored by mix and kept by
mixed.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, settle

BUCKETS = 2048
SAMPLE = 1000
EVIDENCE = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
KEPT_BACK = 4  # one sampled row in so many calibrates the evidence
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
HIGH = 100.0
ROUNDS = 40
WRITE_EVERY = 6
TOLERANCE = 1e-6


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """array<int>: the feature of each word of the text, A-Z lower-cased, repeats included."""
    words = F.split(F.translate(ascii_lower(text), "\t\n\x0b\x0c\r", " " * 5), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("double")


class Classifier:
    """Log priors, and log probabilities of each feature in each domain: BUCKETS numbers a domain."""

    def __init__(self, names: list[str], prior: list[float], weights: list[list[float]], evidence: float = EVIDENCE[0]):
        self.names, self.prior, self.weights, self.evidence = names, prior, weights, evidence

    def mean_logs(self, x: Column) -> Column:
        """array<double>: a document's mean log-likelihood a word in each domain; zeros without a word."""
        tables = F.from_json(F.lit(json.dumps(self.weights)), "array<array<double>>")
        of = lambda w: F.aggregate(x, F.lit(0.0), lambda acc, i: acc + F.get(w, i))
        return F.transform(tables, lambda w: of(w) / F.greatest(F.size(x), F.lit(1)))

    def with_posterior(self, rows: DataFrame, x: Column, out: str) -> DataFrame:
        """rows with the posterior over names, array<double>, from the features x."""
        rows = rows.withColumn("_fm_x", x)
        rows = rows.withColumn("_fm_n", F.least(F.size("_fm_x").cast("double"), F.lit(self.evidence))).withColumn("_fm_m", self.mean_logs(F.col("_fm_x")))
        priors = F.array(*[F.lit(p) for p in self.prior])
        rows = rows.withColumn("_fm_logs", F.zip_with(priors, "_fm_m", lambda p, m: p + m * F.col("_fm_n")))
        rows = rows.withColumn("_fm_e", F.transform("_fm_logs", lambda v: F.exp(v - F.array_max("_fm_logs"))))
        rows = rows.withColumn(out, F.transform("_fm_e", lambda v: v / F.aggregate("_fm_e", F.lit(0.0), lambda a, b: a + b)))
        return rows.drop("_fm_x", "_fm_n", "_fm_m", "_fm_logs", "_fm_e")


def sampled(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, sample: int = SAMPLE) -> DataFrame:
    """(domain, held, x) of at most sample labelled rows a domain."""
    known = labelled.select(F.col(id_col).alias("_fm_l"), F.col(domain_col).cast("string").alias("domain")).filter("_fm_l is not null and domain is not null")
    known = known.distinct().withColumn("h", F.xxhash64("_fm_l", F.lit("mixing labels")))
    chosen = known.groupBy("domain", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min(F.struct("h", "_fm_l")).alias("best"))
    chosen = settle(chosen.select("domain", F.col("best._fm_l").alias("_fm_l"), (F.pmod(F.shiftright("best.h", 24), F.lit(KEPT_BACK)) == 0).alias("held")), "sample")
    texts = docs.select(F.col(id_col).alias("_fm_id"), F.col(text_col).alias("_fm_text"))
    return texts.join(chosen, F.col("_fm_id") == F.col("_fm_l")).select("domain", "held", features(F.col("_fm_text")).alias("x"))


def fit_classifier(rows: DataFrame, buckets: int = BUCKETS) -> Classifier | None:
    """rows: (domain, held, x) of the sampled labelled rows."""
    rows = settle(rows, "labelled")
    sizes = sorted(rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["domain"])  # a row for each domain
    if not sizes:
        return None
    names, whole = [r["domain"] for r in sizes], sum(r["n"] for r in sizes)
    counts = {d: [0.5] * buckets for d in names}
    each = rows.filter("not held").select("domain", F.explode("x").alias("i")).groupBy("domain", "i").agg(F.count(F.lit(1)).alias("n"))
    for r in each.collect():  # bounded: buckets for each domain
        counts[r["domain"]][r["i"]] += r["n"]
    weights = [[math.log(v / sum(counts[d])) for v in counts[d]] for d in names]
    model = Classifier(names, [math.log(r["n"] / whole) for r in sizes], weights)
    held = rows.filter("held").select("domain", F.size("x").alias("n"), model.mean_logs(F.col("x")).alias("m")).collect()  # bounded by the sample
    model.evidence = min(EVIDENCE, key=lambda t: (log_loss(model, held, t), t))
    discard(rows)
    return model


def log_loss(model: Classifier, held: list, evidence: float) -> float:
    loss = 0.0
    for r in held:
        logs = [p + m * min(float(r["n"]), evidence) for p, m in zip(model.prior, r["m"], strict=True)]
        top = max(logs)
        loss += top + math.log(sum(math.exp(v - top) for v in logs)) - logs[model.names.index(r["domain"])]
    return loss


class Rates:
    """The fitted steps: a document's rate follows from its posterior alone."""

    def __init__(self, low: float, high: float, steps: list[list[float]], names: list[str], target: list[float], reached: list[float]):
        self.low, self.high, self.steps, self.names, self.target, self.reached = low, high, steps, names, target, reached

    def _within(self, r: Column) -> Column:
        return F.least(F.lit(self.high), F.greatest(F.lit(self.low), r))

    def of(self, p: Column, start: Column | None = None, since: int = 0) -> Column:
        """The rate for posterior p; the steps are folded in one pass, so that the plan stays small."""
        r = F.lit(1.0) if start is None else start
        if not self.steps[since:]:
            return self._within(r)
        steps = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in self.steps[since:]])
        width = len(self.steps[0])
        return F.aggregate(steps, r, lambda acc, s: self._within(acc - sum((F.get(p, k) * F.get(s, k) for k in range(width)), F.lit(0.0))))


def fit_rates(compact: DataFrame, names: list[str], targets: dict[str, float], low: float = 0.0, total: float = 1.0, high: float = HIGH, rounds: int = ROUNDS) -> Rates:
    """compact: (tokens, p). total: expected tokens after mixing over tokens now."""
    d = len(names)
    first = compact.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * F.get("p", k)).alias(f"s{k}") for k in range(d)]).first()
    whole = first["t"] or 0.0
    asked = [max(0.0, float(targets.get(n, 0.0))) for n in names]
    if not whole or not sum(asked):
        return Rates(low, high, [], names, asked, [])
    share = [max((first[f"s{k}"] or 0.0) / whole, 1e-9) for k in range(d)]
    asked = [a / sum(asked) for a in asked]
    target = [a * total for a in asked]
    fitted, written, since = Rates(low, high, [], names, target, []), compact.withColumn("r", F.lit(1.0)), 0
    for k in range(rounds):
        r = fitted.of(F.col("p"), F.col("r"), since)
        got = written.withColumn("now", r).agg(*[F.sum(F.col("tokens") * F.col("now") * F.get("p", j)).alias(f"a{j}") for j in range(d)]).first()
        fitted.reached = [(got[f"a{j}"] or 0.0) / whole for j in range(d)]
        gap = [a - t for a, t in zip(fitted.reached, target, strict=True)]
        if max(map(abs, gap)) < TOLERANCE * total:
            break
        fitted.steps.append([g / s for g, s in zip(gap, share, strict=True)])
        if len(fitted.steps) - since >= WRITE_EVERY and k < rounds - 1:
            moved = settle(written.withColumn("r", fitted.of(F.col("p"), F.col("r"), since)), "rates")
            if since:
                discard(written)
            written, since = moved, len(fitted.steps)
    if since:
        discard(written)
    return fitted


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str, text_col: str, domain_col: str, low: float, total: float) -> tuple[Classifier | None, Rates | None, DataFrame]:
    """Classifier, rates and the compact table (id, tokens, p) of docs. labelled: rows with an id and a domain."""
    model = fit_classifier(sampled(docs, labelled, id_col, text_col, domain_col))
    own = docs.select(F.col(id_col).alias("id"), token_count(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"), F.col(text_col).alias("_fm_text"))
    if model is None:
        return None, None, own.select("id", "tokens")
    compact = settle(model.with_posterior(own, features(F.col("_fm_text")), "p").select("id", "tokens", "p"), "posteriors")
    return model, fit_rates(compact.select("tokens", "p"), model.names, targets, low, total), compact


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", low: float = 0.0, total: float = 1.0) -> DataFrame:
    """One row per document: id, n_tokens, domain (the likeliest), p_domain, posterior (map), rate."""
    model, rates, rows = fit(docs, labelled, targets, id_col, text_col, domain_col, low, total)
    tokens = F.col("tokens").cast("long").alias("n_tokens")
    if model is None:
        none = [F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("p_domain"), F.create_map().cast("map<string,double>").alias("posterior")]
        return rows.select(F.col("id").alias(id_col), tokens, *none, F.lit(1.0).alias("rate"))
    names, p = F.array(*[F.lit(n) for n in model.names]), F.col("p")
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    return rows.select(F.col("id").alias(id_col), tokens, F.get(names, best).alias("domain"), F.array_max(p).alias("p_domain"), F.map_from_arrays(names, p).alias("posterior"), rates.of(p).alias("rate"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", low: float = 0.0, total: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as its rate says, with all their columns."""
    model, rates, rows = fit(docs, labelled, targets, id_col, text_col, domain_col, low, total)
    discard(rows)
    if model is None:
        return docs
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = model.with_posterior(docs, features(F.col(text_col)), "_fm_p")
    rated = keyed.select(*columns, rates.of(F.col("_fm_p")).alias("_fm_rate"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("mixing")), F.lit(1 << 20)) / float(1 << 20)
    uses = F.floor(F.col("_fm_rate")).cast("int") + (draw < F.col("_fm_rate") - F.floor(F.col("_fm_rate"))).cast("int")
    return rated.select(*columns, F.explode(F.array_repeat(F.lit(1), uses)).alias("_fm_use")).select(*columns)
