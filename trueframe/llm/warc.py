"""Content-addressed WARC archive of web pages.

An archive is two Parquet tables in a shared folder: ``payloads`` holds the
bytes of each distinct payload once, under its SHA-256, and ``headers`` holds
the exact WARC/1.1 header block of every page's record. A record is rebuilt by
joining the two on the digest, which is computed again from the stored bytes.

Pages with equal payloads of at least 100 bytes share one ``response`` record,
that of the smallest page_id; the others are ``revisit`` records that refer to
it. Smaller payloads are all responses, but are still stored once.

Defined results. Null html: an empty payload. Null url: no target header. A url
with control characters is kept in base64, so it cannot forge a header. Null
page_id: never the referred record unless its whole group has none. Rows that
repeat the page_id of their group's response are responses too. An empty table
gives an empty archive. Other columns are ignored, whatever their names.

Writing groups only (id, url, digest, size) rows, and joins the duplicated digests
back to the pages. Reading meets headers and payloads by digest; a payload that
many records use is met in shares of about 256 records, so that a page which is a
third of all rows is rebuilt by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, written

SMALLEST_REVISIT = 100
#: Records that are rebuilt from one copy of a payload; more records get more copies.
SHARE = 256
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def header(page_id: Column, url: Column, digest: Column, size: Column, kind: Column, refers_to: Column) -> Column:
    """The exact header block, with the empty line that ends it."""
    def urn(of: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(of.cast("string"), F.lit("")), F.lit(">"))

    plain = ~url.rlike(r"[\x00-\x1F\x7F]")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", kind), _line("WARC-Record-ID", urn(page_id)),
        F.coalesce(F.when(plain, _line("WARC-Target-URI", url)).otherwise(
            _line("X-Target-URI-Base64", F.base64(F.encode(url, "UTF-8")))), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(kind == "revisit", F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", urn(refers_to)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))), F.lit(CRLF))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write the archive of ``pages``; returns its folder."""
    spark = pages.sparkSession
    folder = shared(spark, "warc")
    bodies = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                          F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    bodies = bodies.withColumn("digest", F.sha2("payload", 256))
    heads = written(bodies.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-heads")
    again = written(heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("owner")).filter("n > 1").select(
        F.col("digest").alias("again_digest"), "owner", "n"), "warc-again")

    repeated = F.col("again_digest").isNotNull()
    owns = F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(repeated & ~owns & (F.col("size") >= SMALLEST_REVISIT), "revisit").otherwise("response")
    typed = heads.join(again, F.col("digest") == F.col("again_digest"), "left").withColumn("kind", kind)
    typed.select("page_id", "digest", F.coalesce("n", F.lit(1)).alias("uses"), header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), F.col("kind"),
                                             F.col("owner")).alias("header")).write.parquet(f"{folder}/headers")

    kept = bodies.select("page_id", "digest", "payload").join(again, F.col("digest") == F.col("again_digest"), "left")
    kept = kept.filter(~repeated | owns)
    # rows of one id and payload are one owner; only the repeated ones need a shuffle to drop them
    kept = kept.select("digest", "payload", F.coalesce("n", F.lit(1)).alias("uses"), repeated.alias("repeated"))
    single = kept.filter("not repeated").drop("repeated")
    single.unionByName(kept.filter("repeated").drop("repeated").dropDuplicates(["digest"])).write.parquet(f"{folder}/payloads")
    return folder


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One parsed row per record: page_id, url, record_type, payload_digest, refers_to, content_length, header, uses."""
    raw = spark.read.schema("page_id long, digest string, uses long, header string").parquet(f"{folder}/headers")
    url = F.coalesce(_field("X-Target-URI-Base64"), F.lit(None).cast("string"))
    return raw.select(
        F.regexp_extract("header", r"\r\nWARC-Record-ID: <urn:page:(-?\d*)>", 1).try_cast("long").alias("page_id"),
        F.when(url.isNotNull(), F.decode(F.unbase64(url), "UTF-8")).when(
            F.col("header").contains("\r\nWARC-Target-URI: "), F.regexp_extract("header", r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1)).alias("url"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("payload_digest"),
        F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d*)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract("header", r"\r\nContent-Length: (\d+)\r\n", 1).try_cast("long").alias("content_length"), "header", "uses")


def _shares() -> Column:
    return F.ceil(F.coalesce("uses", F.lit(1)) / SHARE).cast("int")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads; a digest that its bytes do not have stops the job."""
    raw = spark.read.schema("digest string, payload binary, uses long").parquet(f"{folder}/payloads")
    return raw.select(F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not have the digest "), F.col("digest"))).cast("string")).alias("stored_digest"), "payload", _shares().alias("stored_shares"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records with exact bytes, and each page's full payload."""
    share = F.pmod(F.xxhash64("header", F.monotonically_increasing_id()), _shares()).cast("int").alias("share")
    heads = read_headers(spark, folder).select("*", share)
    stored = read_payloads(spark, folder).select("stored_digest", "payload", F.explode(
        F.sequence(F.lit(0), F.col("stored_shares") - 1)).alias("stored_share"))
    joined = heads.join(stored, (F.col("payload_digest") == F.col("stored_digest")) & (F.col("share") == F.col("stored_share")), "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", "url", "record_type", "refers_to", "payload_digest", "content_length", "header", "payload",
                         F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One row per rebuilt record with the size and digest of its full payload.

    Both are measured on the rebuilt payload; a record whose digest or content
    length is not what its header says stops the job.
    """
    records = read_records(spark, folder).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "rebuilt_digest": F.sha2("payload", 256),
        "body_bytes": F.octet_length("record") - F.octet_length("header") - 4})
    sound = (F.col("rebuilt_digest") == F.col("payload_digest")) & (F.col("body_bytes") == F.col("content_length"))
    return records.select("page_id", "payload_bytes", F.when(sound, F.col("rebuilt_digest")).otherwise(F.raise_error(F.concat(
        F.lit("record does not have the length and digest of its header: "), "header")).cast("string")).alias("payload_digest"),
        "record_type", "refers_to")
