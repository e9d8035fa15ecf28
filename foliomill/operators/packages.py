"""Integrity of packages, over entry, manifest, spine and reference tables.

entry(doc_id, entry_no, name, compressed, head), item(doc_id, item_id, href, media_type, props), spine(doc_id, pos,
idref), ref(doc_id, from_href, ref). Every rule returns (doc_id, level, code, where); validate() stacks them.
"""

from __future__ import annotations

import posixpath
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """A relative reference as a path inside the package. Path arithmetic has no built-in."""
    return pd.Series([posixpath.normpath(posixpath.join(b or "", h or "")) for b, h in zip(base, href, strict=True)], dtype="object")


def _issue(level: str, code: str, where: Column) -> list[Column]:
    return [F.col("doc_id"), F.lit(level).alias("level"), F.lit(code).alias("code"), where.cast("string").alias("where")]


def repeated(items: DataFrame, col: str, level: str, code: str) -> DataFrame:
    return items.groupBy("doc_id", col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_issue(level, code, F.col(col)))


def missing_files(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Packages that are wanted and hold no entry."""
    return docs.join(entries, "doc_id", "left_anti").select(*_issue("error", "missing", F.lit(None)))


def missing_items(items: DataFrame, entries: DataFrame) -> DataFrame:
    e = entries.select("doc_id", F.col("name").alias("href"))
    return items.join(e, ["doc_id", "href"], "left_anti").select(*_issue("error", "missing-item", F.col("href")))


def bad_spine(spine: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    bad = spine.join(items.select("doc_id", F.col("item_id").alias("idref")), ["doc_id", "idref"], "left_anti").select(*_issue("error", "bad-idref", F.col("idref")))
    empty = docs.join(spine, "doc_id", "left_anti").select(*_issue("error", "empty-spine", F.lit(None)))
    return bad.unionByName(empty)


def mimetype(entries: DataFrame) -> DataFrame:
    first = entries.groupBy("doc_id").agg(F.min_by("name", "entry_no").alias("name"))
    order = first.filter("name <> 'mimetype'").select(*_issue("error", "mimetype-order", F.col("name")))
    own = entries.filter("name = 'mimetype'")
    packed = own.filter("compressed").select(*_issue("error", "mimetype-compressed", F.col("name")))
    content = own.filter(F.trim("head") != "application/epub+zip").select(*_issue("error", "mimetype-content", F.col("head")))
    return reduce(DataFrame.unionByName, [order, packed, content])


def navigation(items: DataFrame, spine: DataFrame, docs: DataFrame) -> DataFrame:
    navs = items.filter(F.array_contains(F.split(F.coalesce("props", F.lit("")), " "), "nav")).select("doc_id", "item_id")
    none = docs.join(navs, "doc_id", "left_anti").select(*_issue("error", "no-nav", F.lit(None)))
    out = navs.join(spine.select("doc_id", F.col("idref").alias("item_id")), ["doc_id", "item_id"], "left_anti").select(*_issue("warn", "nav-not-in-spine", F.col("item_id")))
    return none.unionByName(out)


def covers(metas: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """metas: (doc_id, cover_id) of cover declarations."""
    none = docs.join(metas, "doc_id", "left_anti").select(*_issue("warn", "no-cover-meta", F.lit(None)))
    bad = metas.join(items.select("doc_id", F.col("item_id").alias("cover_id")), ["doc_id", "cover_id"], "left_anti").select(*_issue("error", "bad-cover-meta", F.col("cover_id")))
    return none.unionByName(bad)


def dangling(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """Internal references whose target is not in the package."""
    internal = refs.filter(~F.col("ref").rlike("^(?i)(https?|mailto|data|tel|javascript):") & ~F.col("ref").startswith("#"))
    target = internal.withColumn("file", F.regexp_extract("ref", "^([^#?]*)", 1)).withColumn("name", resolve(F.regexp_replace("from_href", "[^/]*$", ""), F.col("file")))
    return target.join(entries.select("doc_id", "name"), ["doc_id", "name"], "left_anti").select(*_issue("error", "dangling-ref", F.col("ref"))).distinct()


@F.pandas_udf(StringType())
def xml_fault(content: pd.Series) -> pd.Series:
    """malformed, not-html or null for XHTML bytes or text; well-formedness needs a parser."""
    from xml.etree import ElementTree as ET

    def one(x):
        try:
            root = ET.fromstring(x or "")
        except (ET.ParseError, ValueError):
            return "malformed"
        return None if root.tag.rsplit("}", 1)[-1] == "html" else "not-html"

    return content.map(one).astype("object")


def malformed(pages: DataFrame) -> DataFrame:
    """pages: (doc_id, name, content)."""
    bad = pages.withColumn("fault", xml_fault("content")).filter("fault is not null")
    return bad.select("doc_id", F.lit("error").alias("level"), F.col("fault").alias("code"), F.col("name").alias("where"))


def containers(entries: DataFrame, docs: DataFrame, rootfiles: DataFrame) -> DataFrame:
    """rootfiles: (doc_id, path) named by the container."""
    has = entries.filter("name = 'META-INF/container.xml'")
    none = docs.join(has, "doc_id", "left_anti").select(*_issue("error", "no-container", F.lit(None)))
    bad = rootfiles.join(entries.select("doc_id", F.col("name").alias("path")), ["doc_id", "path"], "left_anti").select(*_issue("error", "bad-rootfile", F.col("path")))
    return none.unionByName(bad)


def validate(docs: DataFrame, entries: DataFrame, items: DataFrame, spine: DataFrame, refs: DataFrame, metas: DataFrame) -> DataFrame:
    parts = [
        mimetype(entries), repeated(items, "item_id", "error", "dup-id"), repeated(items, "href", "warn", "dup-href"), missing_items(items, entries),
        bad_spine(spine, items, docs), navigation(items, spine, docs), covers(metas, items, docs), dangling(refs, entries),
    ]
    return reduce(DataFrame.unionByName, parts)


def anchors(nav: DataFrame, ids: DataFrame) -> DataFrame:
    """Each navigation entry against element ids: hit, title-differs, miss-id, miss-file or no-fragment.

    nav: (doc_id, pos, title, file, frag); ids: (doc_id, file, frag, text).
    """
    files = ids.select("doc_id", "file").distinct().withColumn("has_file", F.lit(True))
    j = nav.join(ids.select("doc_id", "file", "frag", "text"), ["doc_id", "file", "frag"], "left").join(files, ["doc_id", "file"], "left")
    kind = (
        F.when(F.coalesce("frag", F.lit("")) == "", "no-fragment").when(F.col("has_file").isNull(), "miss-file").when(F.col("text").isNull(), "miss-id")
        .when(F.trim("text") == F.trim("title"), "hit").otherwise("title-differs")
    )
    return j.select("doc_id", "pos", kind.alias("result"))
