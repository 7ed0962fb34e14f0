"""Content-addressed WARC archive.

`write` stores each payload's bytes once, keyed by its SHA-256, and every record's exact header bytes in
a table of its own, which names the payload by that key. `read` parses the headers and rebuilds the
original records by a join to the payload store; it verifies each payload against its key. The first
record (smallest page_id) with a payload is a response, later ones are revisits that refer to it;
payloads of fewer than `least` bytes are stored for every record that has them as responses.

`export_warc` writes the archive as a standard WARC text (one gzip file per partition), `parse_warc` reads
such bytes.

The digest is verified when written as well: payloads count as equal only if SHA-256, SHA-1 and length agree.

Cases: a null html is an empty payload; a payload is one value, so of 2 GB at most; pages without an id come after all others (as the
first holder of a payload they are referred to by null); ids must be whole numbers (an error otherwise); rows that repeat a page are records of their own, the first
(by url) of which is the response; an empty table gives an empty archive; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common

#: The base32 alphabet (RFC 4648) in the order of digits 0-9a-v.
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits, ten hexadecimal digits, are eight of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.upper(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), *BASE32)


def _header(response: Column) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:midbase:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.col("copy").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: <urn:midbase:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(":1>"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write page records to path/headers and path/payloads."""
    if not isinstance(pages.schema["page_id"].dataType, IntegralType):
        raise ValueError("ids must be whole numbers")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    same = ["sha256", "sha1", "bytes"]
    records = rows.groupBy(*same, "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    records = common.staged(records, "records")
    first = records.groupBy(*same).agg(F.min("page_id").alias("first"))
    urls = records.join(first.hint("merge"), same).filter("page_id <=> first").groupBy(*same).agg(F.min(F.struct(F.coalesce("url", F.lit("")), "url")).alias("u"))
    first = first.join(urls.hint("merge"), same).select(*same, "first", F.col("u.url").alias("first_url"))
    records = records.join(first.hint("merge"), same).withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
    leads = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 1)
    response = leads | (F.col("bytes") < least)
    headers = records.select(F.col("sha256").alias("payload_key"), _header(response).alias("header"))
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    stored = rows.groupBy(*same).agg(F.first("payload").alias("payload"))
    stored.select(F.col("sha256").alias("payload_key"), "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: header, payload (verified), and the header's fields."""
    headers = spark.read.schema("payload_key string, header string").parquet(f"{path}/headers")
    stored = spark.read.schema("payload_key string, payload binary").parquet(f"{path}/payloads")
    checked = stored.select("payload_key", F.when(F.sha2("payload", 256) == F.col("payload_key"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_key"))).cast("binary")
    ).alias("payload"))
    field = lambda name, value: F.nullif(F.regexp_extract("header", rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    return headers.join(checked.hint("merge"), "payload_key").select(
        "header", "payload", "payload_key",
        field("WARC-Record-ID", r"<urn:midbase:page:(-?\d*):\d+>").cast("long").alias("page_id"),
        field("WARC-Target-URI", r"([^\r]*)").alias("url"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Refers-To", r"<urn:midbase:page:(-?\d*):1>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", r"sha1:([A-Z2-7]+)").alias("payload_digest"),
        field("Content-Length", r"(\d+)").cast("long").alias("content_length"),
    )


def original(records: DataFrame) -> Column:
    """A record's bytes as first captured: header, payload, two line ends."""
    return F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.encode(F.lit(CRLF + CRLF), "UTF-8"))


def export_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC text: payloads of responses in full, revisits with theirs left out."""
    body = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    length = F.octet_length(body).cast("string")
    header = F.regexp_replace("header", r"Content-Length: \d+", F.concat(F.lit("Content-Length: "), length))
    records.select(F.concat(header, body).alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record in uncompressed WARC bytes."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        begin = end + 4
        at = begin + int(fields["Content-Length"])
        yield fields, data[begin:at]


@common.owned
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path, least=0)
    records = read(spark, path)
    payload = F.col("payload")
    intact = (base32_sha1(payload) == F.col("payload_digest")) & (F.octet_length(payload) == F.col("content_length"))
    return records.select(
        "page_id", F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.when(intact, F.col("payload_digest")).otherwise(F.raise_error(F.lit("damaged record"))).alias("payload_digest"),
        "record_type", "refers_to",
    )


#: DuckDB's sha1 gives hexadecimal; 5 hexadecimal digits are 4 of base 32.
ORACLE = r"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1), '' ORDER BY i)
        FROM range(32) AS r(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
