"""Content-addressed WARC archive.

An archive is two Parquet tables below one folder:

``headers``   one row per WARC record: its key, record type, the exact header
              block as bytes, and the SHA-256 of the payload that it stands for
``payloads``  every distinct payload once, addressed by its SHA-256

The original record is the join of the two: header block, payload (for a
response), and the closing blank lines.  Digests are computed again on reading,
so a damaged payload is an error and not a wrong record.

All steps are DataFrame expressions.  The payload table is made by a group-by
that keeps one copy per digest, with map-side combination, so a page that a
third of the table repeats costs one row per task.  A page of any length is one row.

Cases: a null payload is written as the empty payload and so shares its digest; rows with a
null key are kept (they sort first as record keys); equal keys with equal
payloads give one record per row; an empty table gives an empty archive; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, table

# Digits of base 32 as Java writes them, and RFC 4648's alphabet.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column.

    160 bits are four groups of 40, and each group is eight base-32 digits.
    """
    hexed = F.sha1(payload)
    groups = [
        F.lpad(F.upper(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32)), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*groups), _DIGITS, _RFC4648)


def records(pages: DataFrame, key: str, uri: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """One row per page: what its record says, without the payload.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest key is the response, the others revisit it.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).alias("page_id"),
        F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"),
        F.length(body).cast("long").alias("payload_bytes"),
        base32_sha1(body).alias("payload_digest"),
        F.sha2(body, 256).alias("payload_sha256"),
    )
    first = rows.groupBy("payload_sha256").agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "payload_sha256", "left").select(
        "page_id",
        "uri",
        "payload_bytes",
        "payload_digest",
        "payload_sha256",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _header_block(date: str) -> Column:
    """The record's header block; a revisit has no body, so its length is 0."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))

    # a header line ends at CRLF, so line breaks inside a URI are percent-encoded
    uri = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    text = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(_CRLF),
    )
    return F.encode(text, "UTF-8")


def write_archive(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write the archive of ``pages`` below ``path``."""
    records(pages, key, uri, payload, min_bytes).select(
        "page_id", "record_type", "payload_sha256", _header_block(date).alias("header")
    ).write.parquet(f"{path}/headers")
    # One copy of each payload; the partial aggregate drops copies before the shuffle.
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    pages.select(F.sha2(body, 256).alias("payload_sha256"), body.alias("payload")).groupBy("payload_sha256").agg(
        F.first("payload").alias("payload")
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, rebuilt by the join of headers and payloads.

    ``record`` holds the exact bytes of the original record.  A payload whose
    digest differs from its address, or a header without payload, is an error.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "payload_sha256",
        F.when(F.sha2("payload", 256) == F.col("payload_sha256"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("binary"))
        .alias("payload"),
    )
    joined = headers.join(payloads, "payload_sha256", "left").withColumn(
        "payload",
        F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(
            F.raise_error(F.lit("the archive lacks a payload")).cast("binary")
        ),
    )
    text = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        return F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)

    end = F.encode(F.lit(_CRLF * 2), "UTF-8")
    return joined.select(
        F.regexp_extract(field("WARC-Record-ID"), r"^<urn:page:(.*)>$", 1).alias("record_key"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("uri"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.when(
            F.col("record_type") == "revisit", F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1)
        ).alias("refers_to"),
        "payload",
        F.when(F.col("record_type") == "revisit", F.concat("header", end))
        .otherwise(F.concat("header", "payload", end))
        .alias("record"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive ``pages``, read the archive back and report every record, with the SHA-256 of its exact bytes.

    A key that is no whole number comes back as a null page_id here; ``read_archive`` has it as text.
    """
    path = new_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path)
    digest = base32_sha1(F.col("payload"))
    return back.select(
        F.expr("try_cast(record_key as bigint)").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(digest == F.col("payload_digest"), digest)
        .otherwise(F.raise_error(F.lit("a header's digest differs from its payload")).cast("string"))
        .alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
        F.sha2("record", 256).alias("record_sha256"),
    )


OP2_SQL = """
WITH r AS (
  SELECT page_id, coalesce(html, '') AS html, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS uri,
         octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, sha256(coalesce(html, '')) AS k
  FROM pages
), d AS (
  SELECT page_id, html, uri, CAST(payload_bytes AS BIGINT) AS payload_bytes, k,
         translate(upper(
           to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32, 8) ||
           to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32, 8)),
           '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
         min(page_id) OVER (PARTITION BY k) AS first_id
  FROM r
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
       sha256(array_to_string(list_filter([
         'WARC/1.1', 'WARC-Type: ' || CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END, 'WARC-Record-ID: <urn:page:' || page_id || '>',
         'WARC-Target-URI: ' || uri, 'WARC-Date: 1970-01-01T00:00:00Z', 'WARC-Payload-Digest: sha1:' || payload_digest, 'X-Payload-Length: ' || payload_bytes,
         CASE WHEN page_id <> first_id THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
         CASE WHEN page_id <> first_id THEN 'WARC-Refers-To: <urn:page:' || first_id || '>' END,
         'Content-Type: text/html', 'Content-Length: ' || CASE WHEN page_id = first_id THEN payload_bytes ELSE 0 END, '',
         CASE WHEN page_id = first_id THEN html ELSE '' END || chr(13) || chr(10), ''], lambda x: x IS NOT NULL), chr(13) || chr(10))) AS record_sha256
FROM d
"""
