"""URL filters: rules first, then a character language-model ratio.

Two variable-order Markov models are trained on the distinct URLs that rules accept and reject, all of them, whole. A
model predicts each character from its longest known context of up to ORDER characters and blends the orders below it
(Witten-Bell):  P_n(c | s) = (N(s, c) + K(s) P_n-1(c | s')) / (N(s) + K(s)),  K the number of characters seen after s,
s' without its first character, P_-1 = 1 / ALPHABET, and P_n = P_n-1 where s was never seen. A URL that no rule fits is
judged by the difference of its two log-likelihoods per character, minus a threshold calibrated on one rule URL in
five, which the models have not seen.

Everything is DataFrame functions. A URL is a sequence of grams (ORDER characters and the one they predict); counts of
grams and of their shorter suffixes are partially aggregated sums that grow with the rule URLs. The log ratio is worked
out once for each distinct gram that is asked for, by joins order by order, and a URL's score is the sum over its grams.
No model is sent to tasks as such; Spark broadcasts a table only where its size allows. The threshold comes from a
histogram of all held-out scores in steps of STEP, which has a bounded number of cells.

Skew: hot hosts and hot grams are pre-aggregated before they move; the one join of all positions with the ratios is
split by adaptive execution where a gram is hot, since each gram stands once on the other side.

Defined results: null urls and urls without "://" have an empty host and path; no rule fits them. A null or empty url
has difference 0 and is judged against the threshold like any other. Where one class has no URL to learn from, the
model's verdict is the other class's; with neither it is allow. Of rules of equal length the first by text wins.
Repeated rows are judged each, but a repeated URL is learned from once. Very long URLs are read whole. An empty table
gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, settle

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
ALPHABET = 256
HELD_OUT = 5  # one rule URL in so many calibrates the threshold
STEP = 1e-3
BEGIN, END = "\x02", "\x03"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_fm_url, instr(_fm_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def with_rules(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """id, url, host, path, rule, rule_verdict: the longest rule that fits, else null."""
    rows = pages.select(F.col(id_col).alias("_fm_id"), F.col(url_col).cast("string").alias("_fm_url"))
    host, path = split_url(F.col("_fm_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last that fits wins
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def grams(url: Column) -> Column:
    """array<string>: each character of the url and an end mark, behind the ORDER characters before it."""
    line = F.concat(F.lit(BEGIN * ORDER), url, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(url) + 1), lambda i: F.substring(line, i, F.lit(ORDER + 1)))


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, na, nb) over urls (said, url): how often accepted and rejected URLs have it."""
    each = urls.select("said", F.explode(grams(F.col("url"))).alias("gram"))
    times = lambda x: F.sum(F.when(F.col("said") == x, 1).otherwise(0)).cast("double")
    return each.groupBy("gram").agg(times("allow").alias("na"), times("block").alias("nb"))


def log_ratios(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, ratio): log P(accepted) - log P(rejected) of the last character, for each gram of asked."""
    last = lambda n: F.expr(f"right(gram, {n + 1})")  # noqa: E731 - a context of n characters and the one after it
    now = asked.select("gram").distinct()
    levels = [now.select(last(n).alias("x")).distinct() for n in range(ORDER)] + [now.select(F.col("gram").alias("x"))]
    below = None
    for n in range(ORDER + 1):
        seen = counts.groupBy(last(n).alias("x")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        seen = settle(seen.withColumn("s", F.expr(f"left(x, {n})")), "counts")
        kinds = lambda c: F.sum(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
        context = seen.groupBy("s").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), kinds("na").alias("ka"), kinds("nb").alias("kb"))
        rows = levels[n].withColumn("s", F.expr(f"left(x, {n})")).join(seen.drop("s"), "x", "left").join(context, "s", "left")
        if below is None:
            rows = rows.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pb", F.lit(1.0 / ALPHABET))
        else:
            rows = rows.withColumn("y", F.expr(f"right(x, {n})")).join(below.withColumnRenamed("x", "y"), "y")

        def blended(c: str) -> Column:
            total, k, p = F.coalesce(f"t{c}", F.lit(0.0)), F.coalesce(f"k{c}", F.lit(0.0)), F.col(f"p{c}")
            return F.when(total > 0, (F.coalesce(f"n{c}", F.lit(0.0)) + k * p) / (total + k)).otherwise(p).alias(f"p{c}")

        below = settle(rows.select("x", blended("a"), blended("b")), "order")
    return below.select(F.col("x").alias("gram"), (F.ln("pa") - F.ln("pb")).alias("ratio"))


def differences(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(u, difference) over rows (u, url): the mean log ratio of a url's grams. Urls are not empty."""
    each = rows.select("u", F.explode(grams(F.col("url"))).alias("gram")).join(ratios, "gram")
    return each.groupBy("u").agg((F.sum("ratio") / F.count(F.lit(1))).alias("difference"))


def threshold(scores: DataFrame) -> float:
    """scores: (said, difference) of held-out URLs. The cut with the best balanced accuracy, nearest to 0 of several."""
    cell = F.floor(F.col("difference") / STEP).cast("long").alias("cell")
    one = lambda x: F.sum(F.when(F.col("said") == x, 1).otherwise(0)).alias(x)
    # a mean log ratio lies within plus or minus log(ALPHABET * counts), so cells are some ten thousands at most
    cells = scores.groupBy(cell).agg(one("allow"), one("block")).orderBy("cell").collect()
    good, bad = sum(r["allow"] for r in cells), sum(r["block"] for r in cells)
    if not good or not bad:
        return 0.0
    best, passed, stopped, before = (1.0, 0.0), 0, 0, None
    for r in cells:
        cut = r["cell"] * STEP if before is None else (before + 1 + r["cell"]) / 2 * STEP
        right = (good - passed) / good + stopped / bad
        best = max(best, (round(right, 12), -abs(cut), cut)) if len(best) == 3 else (round(right, 12), -abs(cut), cut)
        passed, stopped, before = passed + r["allow"], stopped + r["block"], r["cell"]
    return best[-1]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """id, host, path, rule, verdict, difference for every row; difference is the model's, null where a rule decides."""
    ruled = settle(with_rules(pages, id_col, url_col, rules).withColumn("u", F.monotonically_increasing_id()), "urls")
    known = ruled.filter("rule_verdict is not null and _fm_url <> ''").select(F.col("rule_verdict").alias("said"), F.col("_fm_url").alias("url")).distinct()
    known = settle(known.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0), "known")
    learned = {r["said"] for r in known.filter("not held").select("said").distinct().collect()}
    columns = [F.col("_fm_id").alias(id_col), "host", "path", "rule"]
    if len(learned) < 2:
        said = learned.pop() if learned else "allow"
        return ruled.select(*columns, F.coalesce("rule_verdict", F.lit(said)).alias("verdict"), F.lit(0.0).alias("difference"))
    counts = settle(gram_counts(known.filter("not held").select("said", "url")), "grams")
    open_rows = ruled.filter("rule_verdict is null and _fm_url <> ''").select("u", F.col("_fm_url").alias("url"))
    held = settle(known.filter("held").withColumn("u", F.monotonically_increasing_id()).select("u", "said", "url"), "held")
    asked = reduce(DataFrame.unionByName, [x.select(F.explode(grams(F.col("url"))).alias("gram")).distinct() for x in (open_rows, held)])
    ratios = log_ratios(counts, asked)
    cut = threshold(held.join(differences(held, ratios), "u"))
    scores = settle(differences(open_rows, ratios), "differences")
    discard(held)
    discard(known)
    found = ruled.join(scores, "u", "left")
    own = F.coalesce("difference", F.lit(0.0))
    verdict = F.coalesce("rule_verdict", F.when(own >= cut, "allow").otherwise("block"))
    return found.select(*columns, verdict.alias("verdict"), F.when(F.col("rule_verdict").isNull(), own).alias("difference"))
