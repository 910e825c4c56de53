"""Operator 6, WARC: a content-addressed archive.

``write_archive`` stores every distinct payload once, under its SHA-256, and
every record's exact header block beside it; ``read_archive`` verifies the
stored bytes against their digests; ``records`` joins the two tables back to
the original record bytes.

Layout below one folder of shared storage::

    payloads/  sha256, payload binary, first_id, copies long   one row per distinct payload, and how many records have it
    headers/   sha256, header binary                           one row per record

Defined cases: a null payload is empty; equal payloads (empty ones too) make
one response, the record with the smallest id, and revisits; rows that
repeat an id and payload are the same record and get the same type; a null
id sorts last and is written as an empty name; line breaks in a URL are
percent-encoded, so that they cannot end a header line; a null URL writes no
target line; an empty table writes an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import salted_join

#: Digits of base 32 as Spark's conv writes them, and those of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAYLOADS, HEADERS = "sha256 binary, payload binary", "sha256 binary, header binary"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1: eight pieces of 20 bits, four digits each."""
    digest = F.upper(F.sha1(payload))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]), DIGITS, BASE32)


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def _record_id(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))


def header(record_id: Column, url: Column, is_response: Column, refers_to: Column, sha1: Column, size: Column, date: str) -> Column:
    """The exact header block of a record, with the empty line that ends it."""
    target = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    revisit = F.concat(_line("WARC-Refers-To", _record_id(refers_to)), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(is_response, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", _record_id(record_id)),
        F.coalesce(_line("WARC-Target-URI", target), F.lit("")),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(is_response, F.lit("")).otherwise(revisit),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` below ``path``, which must be shared storage and new."""
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(text, "UTF-8").alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    # copies meet in each task before the shuffle, so a hot payload travels once per task
    stored = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.min("id").alias("first_id"), F.count("*").alias("copies"))
    stored.write.parquet(f"{path}/payloads")
    first = spark.read.schema("sha256 binary, first_id " + dict(rows.dtypes)["id"]).parquet(f"{path}/payloads")
    facts = rows.select("id", "url", "sha256", sha1_base32(F.col("payload")).alias("sha1"), F.octet_length("payload").alias("size"))
    block = header(F.col("id"), F.col("url"), F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"), F.col("sha1"), F.col("size"), date)
    met = salted_join(facts, first, "sha256", counts=_copies(spark, path))
    met.select("sha256", F.encode(block, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; reading fails if any differ from the digest they are stored under."""
    rows = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    good = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    return rows.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("sha256"))).cast("binary")))


def _copies(spark: SparkSession, path: str) -> DataFrame:
    """Records per stored payload (sha256, n), by which hot payloads are dealt over tasks."""
    return spark.read.schema("sha256 binary, copies long").parquet(f"{path}/payloads").select("sha256", F.col("copies").alias("n"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADERS).parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it was: ``record`` binary (header, payload, two line ends)."""
    whole = F.concat("header", "payload", F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return salted_join(read_headers(spark, path), read_payloads(spark, path), "sha256", counts=_copies(spark, path)).select(whole.alias("record"))


def field(block: Column, name: str) -> Column:
    """A header line's value, or null if there is no such line."""
    got = F.regexp_extract(block, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.instr(block, f"\r\n{name}: ") > 0, got)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each record: id (long), size and SHA-1 of the payload as stored, type, refers_to.

    The payloads' own figures are worked out once per distinct payload, from
    the verified bytes, and must agree with the record's header.
    """
    payload = read_payloads(spark, path).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    block = F.decode("header", "UTF-8")
    number = lambda name: F.regexp_extract(field(block, name), "^<urn:page:(-?[0-9]+)>$", 1)
    whole = lambda x: F.when(F.length(x) > 0, x.cast("long"))
    rows = read_headers(spark, path).select(
        "sha256", whole(number("WARC-Record-ID")).alias("page_id"), field(block, "WARC-Type").alias("record_type"),
        whole(number("WARC-Refers-To")).alias("refers_to"), F.concat(field(block, "WARC-Payload-Digest"), F.lit(" "), field(block, "Content-Length")).alias("said"))
    out = salted_join(rows, payload, "sha256", counts=_copies(spark, path))
    agrees = F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"), F.lit(" "), F.col("payload_bytes").cast("string"))
    digest = F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("said"))))
    return out.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
