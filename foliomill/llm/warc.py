"""Content-addressed WARC archive.

Payload bytes are stored once, under their verified SHA-256 digest; the exact header block of every record is stored
separately. Two Parquet tables make an archive:

  payloads  (sha256, payload)   one row per distinct payload, in buckets by digest
  headers   (sha256, header)    one row per record: the address of its payload and its exact header block

Records are reconstructed by a join on the digest: header block, blank line, payload (responses) or nothing
(revisits, which carry the digest and the id of the response they refer to). What a reader reports comes from the
rebuilt bytes: the type, the id, the target and the length are parsed from the record's own header. A stored payload
that does not match its address, a length that is not the body's and a digest line that is not the payload's each stop
the read.

Skew: one payload per digest is chosen by a partially aggregated max, so a hot digest sends one payload a task.
Payload bytes move once, when they are written; the buckets spare the read a second move. Revisits of a hot digest
never meet payload bytes, only its length and digest, in a plain join that adaptive execution splits.

Defined results: a null html is an empty payload; a null url leaves out the target line; payloads shorter than
min_bytes are all responses. Null page ids come after every other id; repeated rows with the same id and payload are
all responses where that id is the one chosen, and share one stored payload. A very long payload is one value. Other
columns of pages, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, settle, shuffle_partitions

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 160 bits are 8 groups of 20 bits, each 5 hex digits and 4 letters."""
    digest = F.sha1(payload)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def _header(record_type: Column, page: Column, url: Column, date: str, n: Column, sha1: Column, refers: Column) -> Column:
    """The exact header block of a WARC/1.1 record."""
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:page>"))
    revisit = record_type == "revisit"
    line = lambda name, value, when=F.lit(True): F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    clean = F.regexp_replace(url, r"[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", urn(page)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean, url.isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Refers-To", urn(refers), revisit),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(n.cast("string"))),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of pages under path."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.unhex(F.sha2(payload, 256)).alias("sha256"), payload.alias("payload"))
    buckets, name = shuffle_partitions(spark), f"foliomill_{uuid.uuid4().hex}"
    stored = rows.groupBy("sha256").agg(F.max(F.struct("page_id", "payload")).alias("one")).select("sha256", F.col("one.payload").alias("payload"))
    stored.write.bucketBy(buckets, "sha256").option("path", f"{path}/payloads").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; readers name them again
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")
    small = rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    # the smaller side is written first, so that both sides of the join are dealt out afresh and a hot digest can be split
    best = rows.groupBy(F.col("sha256").alias("best_sha")).agg(F.max("page_id").alias("best_id"))
    best.write.parquet(f"{path}/chosen")
    joined = small.join(spark.read.schema(best.schema).parquet(f"{path}/chosen"), F.col("sha256") == F.col("best_sha"))
    kind = F.when((F.col("n") < min_bytes) | F.col("page_id").eqNullSafe(F.col("best_id")), "response").otherwise("revisit")
    header = _header(kind, F.col("page_id"), F.col("url"), date, F.col("n"), F.col("sha1"), F.col("best_id"))
    joined.select("sha256", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload) in their buckets, each checked against its address: a payload with another digest stops the read."""
    name = f"foliomill_{uuid.uuid4().hex}"
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    spark.sql(f"CREATE TABLE {name} (sha256 BINARY, payload BINARY) USING parquet CLUSTERED BY (sha256) INTO {buckets} BUCKETS LOCATION '{path}/payloads'")
    rows = spark.table(name)
    ok = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    out = rows.select("sha256", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("stored payload does not match its digest")).cast("binary")).alias("payload"))
    out.schema  # noqa: B018 - resolved now, so that the name is not needed any more
    spark.sql(f"DROP TABLE {name}")
    return out


def _line(header: Column, name: str) -> Column:
    """The value of a header line, null where there is none."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(header: Column, name: str, kind: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(header, rf"(?m)^{name}: <urn:page:([^>\r\n]*)>", 1), F.lit(""))).cast(kind)


def _parsed(records: DataFrame, kind: str) -> DataFrame:
    """records: (sha256, record). What the records' own bytes say, checked: type, id, target, digest, length and body."""
    text = F.col("record").cast("string")  # the same bytes
    cut = records.withColumn("header", F.substring_index(text, CRLF * 2, 1))
    at = F.octet_length("header") + 4
    cut = cut.withColumn("body", F.substring("record", at + 1, F.octet_length("record") - at - 4))
    rows = cut.select(
        "sha256",
        "record",
        "body",
        _page(F.col("header"), "WARC-Record-ID", kind).alias("page_id"),
        _line(F.col("header"), "WARC-Type").alias("record_type"),
        _page(F.col("header"), "WARC-Refers-To", kind).alias("refers_to"),
        F.replace(_line(F.col("header"), "WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("said"),
        _line(F.col("header"), "Content-Length").cast("long").alias("length"),
    )
    known = F.col("record_type").isin("response", "revisit")
    whole = known & F.col("said").isNotNull() & F.col("length").eqNullSafe(F.octet_length("body").cast("long"))
    # in a column that every reader takes, or it would be pruned away
    return rows.withColumn("record_type", F.when(whole, F.col("record_type")).otherwise(F.raise_error(F.lit("a record's header does not fit its bytes"))))


def read_records(spark: SparkSession, path: str, kind: str = "bigint", record_type: str | None = None) -> DataFrame:
    """Every record with its exact bytes, rebuilt by joins: sha256, page_id, record_type, refers_to, said (digest line), length, body, record.

    kind: the SQL type of page ids. record_type: only records of that type, by their headers.
    """
    end = F.lit(CRLF.encode())
    headers = spark.read.schema("sha256 binary, header binary").parquet(f"{path}/headers")
    own = _line(F.col("header").cast("string"), "WARC-Type")
    responses = headers.filter(own == "response").join(read_payloads(spark, path), "sha256")
    responses = responses.select("sha256", F.concat("header", end, "payload", end, end).alias("record"))
    others = headers.filter(~own.eqNullSafe("response")).select("sha256", F.concat("header", end, end, end).alias("record"))
    asked = {"response": responses, "revisit": others}.get(record_type) if record_type else responses.unionByName(others)
    return _parsed(asked, kind)


def read_digests(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Every record with length and digest of its full payload, from rebuilt records: a revisit's from the response it refers to."""
    agrees = lambda said, found: F.when(said == found, said).otherwise(F.raise_error(F.lit("a record's digest line is not its payload's")))
    responses = read_records(spark, path, kind, "response")
    responses = settle(responses.select("sha256", "page_id", "record_type", "refers_to", F.col("length").alias("payload_bytes"), agrees(F.col("said"), base32_sha1(F.col("body"))).alias("payload_digest")), "responses")
    stored = settle(responses.select("sha256", F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("sha1")).dropDuplicates(["sha256"]), "digests")
    revisits = read_records(spark, path, kind, "revisit").select("sha256", "page_id", "record_type", "refers_to", "said").join(stored, "sha256", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = revisits.withColumn("payload_bytes", F.col("n")).withColumn("payload_digest", agrees(F.col("said"), F.col("sha1")))
    return responses.select(*columns).unionByName(revisits.select(*columns))


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages as an archive, then read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archive")
    write_archive(pages, path, min_bytes=min_bytes)
    return read_digests(spark, path, pages.schema["page_id"].dataType.simpleString())


def _oracle() -> str:
    """SQL for archive_round_trip over the table pages."""
    bits = [f"CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER)" for g in range(8)]
    letters = " || ".join(f"substr('{BASE32}', (({b} >> {shift}) & 31) + 1, 1)" for b in bits for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, sha256(body) AS s FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS best FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN NULL ELSE best END AS refers_to
FROM b
"""


ORACLE = _oracle()
