"""The registered queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, langid, mixing, packing, simhash, suffixdedup, topk, toxicity, urlfilter, warc
from .common import table


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang) of the documents that the labels table calls good: the labelled table of the mixing classifier."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good_id"))
    return docs.select("doc_id", "lang").join(good, F.col("doc_id") == F.col("good_id"), "left_semi")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_best_fit_packing, op4_url_filter, op5_language_id, op6_simhash, op7_exact_dedup, op8_warc, op9_suffix_dedup, op10_exact_topk)}

ORACLES = {"op7_exact_dedup": exactdedup.ORACLE, "op8_warc": warc.ORACLE, "op10_exact_topk": topk.ORACLE}
