"""Quality rules on source and target text, engine judgement, and summaries of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliomill.functions import fixed as X
from foliomill.functions import text as t


def _missing_term(glossary: list[tuple[str, str]], source: Column, target: Column) -> Column:
    """The first glossary term (in order) that the source has and whose rendering the target lacks."""
    terms = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("expected")) for a, b in glossary]) if glossary else F.lit(None).cast("array<struct<term:string,expected:string>>")
    bad = F.filter(terms, lambda e: (e["term"] != "") & (e["expected"] != "") & source.contains(e["term"]) & ~target.contains(e["expected"]))
    return F.get(bad, 0)["term"]


def issues(pairs: DataFrame, glossary: list[tuple[str, str]] = (), min_ratio: float = X.MIN_RATIO, max_ratio: float = X.MAX_RATIO, min_source: int = X.MIN_SOURCE) -> DataFrame:
    """seg_id, kind, severity for each issue. A segment without a target stops; so does one equal to its source."""
    once = pairs.select("seg_id", "status", t.text_of("source").alias("_s"), F.trim(t.text_of("target")).alias("_t"))
    once = once.select("*", t.remove_ws("_s").alias("_bs"), t.remove_ws("_t").alias("_bt"))  # each text is stripped once, not in every rule
    src, tgt, bare_src, bare_tgt = (F.col(c) for c in ("_s", "_t", "_bs", "_bt"))
    none = tgt == ""
    same = ~none & (bare_tgt == bare_src)
    go = ~none & ~same
    hira, kata = tgt.rlike(f"[{X.HIRAGANA}]"), tgt.rlike(f"[{X.KATAKANA}]")
    n = F.length(bare_src)
    ratio = F.length(bare_tgt) / F.nullif(n, F.lit(0))
    rule = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    warn, error = F.lit("warn"), F.lit("error")
    found = F.array(
        rule(none, "untranslated", F.when(F.col("status") == "pending", warn).otherwise(error)),
        rule(same & (bare_src != "") & t.has_kana(bare_src), "source_leak", error),
        rule(go & hira, "kana_left", error),
        rule(go & ~hira & kata, "katakana_left", warn),
        rule(go & (F.size(t.traditional_chars(tgt)) >= 2), "traditional", warn),
        rule(go & _missing_term(list(glossary), src, tgt).isNotNull(), "term_missing", error),
        rule(go & (n >= min_source) & ((ratio < min_ratio) | (ratio > max_ratio)), "length_anomaly", warn),
    )
    return once.select("seg_id", F.explode(F.array_compact(found)).alias("i")).select("seg_id", "i.kind", "i.severity")


def missing_terms(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """seg_id and the first violated term, by a join with a glossary table (gl_order, term, expected)."""
    hit = F.col("source").contains(F.col("term")) & ~F.col("target").contains(F.col("expected"))
    joined = pairs.filter("target <> ''").join(glossary, hit)  # glossaries are edited by hand; Spark broadcasts them by size
    return joined.groupBy("seg_id").agg(F.min_by("term", "gl_order").alias("term"))


def judge(pairs: DataFrame, glossary: list[tuple[str, str]] = ()) -> DataFrame:
    """seg_id, kind: an engine's output. Empty output stops; all other rules add up."""
    src, tgt = t.text_of("source"), t.text_of("target")
    empty = F.trim(tgt) == ""
    hira, kata = tgt.rlike(f"[{X.HIRAGANA}]"), tgt.rlike(f"[{X.KATAKANA}]")
    n, m = F.length(t.normalize_ws(src)), F.length(t.normalize_ws(tgt))
    bad_length = (n >= X.MIN_SOURCE) & ((m / F.greatest(n, F.lit(1)) < X.MIN_RATIO) | (m / F.greatest(n, F.lit(1)) > X.MAX_RATIO))
    rule = lambda when, kind: F.when(when, F.lit(kind))
    found = F.array(
        rule(empty, "empty"), rule(~empty & t.is_untranslated(src, tgt), "untranslated"), rule(~empty & hira, "kana_left"), rule(~empty & ~hira & kata, "katakana_left"),
        rule(~empty & bad_length, "length_anomaly"), rule(~empty & _missing_term(list(glossary), src, tgt).isNotNull(), "term_missing"), rule(~empty & (F.size(t.traditional_chars(tgt)) >= 2), "traditional"),
    )
    return pairs.select("seg_id", F.explode(F.array_compact(found)).alias("kind"))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def passed(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether there is no error."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warn")
    return found.agg(errors.alias("errors"), warnings.alias("warnings")).withColumn("ok", F.col("errors") == 0)


def examples(found: DataFrame, n: int) -> DataFrame:
    """The first n issues of each kind."""
    w = W.partitionBy("kind").orderBy("seg_id")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def engine_report(outputs: DataFrame, problems: DataFrame) -> DataFrame:
    """engine, segments, output characters, issues and issues per thousand characters."""
    a = outputs.groupBy("engine").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("target")).alias("out_chars"))
    b = problems.groupBy("engine").agg(F.count(F.lit(1)).alias("issues"))
    return a.join(b, "engine", "left").select("engine", "segments", "out_chars", F.coalesce("issues", F.lit(0)).alias("issues"), F.round(F.coalesce("issues", F.lit(0)) * 1000.0 / F.nullif("out_chars", F.lit(0)), 6).alias("per_thousand"))


def side_by_side(outputs: DataFrame, engines: list[str]) -> DataFrame:
    """One row a segment, one column an engine."""
    return outputs.groupBy("seg_id").pivot("engine", engines).agg(F.first("target"))
