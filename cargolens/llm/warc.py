"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds each distinct payload once, under its SHA-256, in buckets of that address.
``records`` holds every record's exact header bytes and the address of its payload. Original records are rebuilt by
joining the two: a response's bytes are its header and its payload, a revisit's are its header. On reading, each stored
payload is hashed again, and a record counts as verified only if that hash is its address and its header names the digest
of its payload.

Payloads are deduplicated in one aggregation whose map side keeps one copy per task, so a payload that a third of all
pages share is moved a few times. When records are rebuilt, headers go to the buckets of payloads, so no payload is
dealt again. Records of an address that very many share are revisits, which need its length and digest only, or have
payloads under ``least`` bytes: those addresses are broadcast after counting them (``common.spread_join``).

``write_files`` and ``read_files`` exchange archives with other tools as WARC 1.1 files.

A bucket's place follows from its address alone, so any session reads an archive by its buckets; how many there are is
stored beside them (``layout``). Sessions know the buckets by a table of a new name, which is dropped at once.

Defined results: a null payload is empty; payloads under ``least`` bytes are always responses; of equal longer ones the
largest id is the response, the others are revisits that refer to it. Rows that repeat the largest id are all responses.
A record whose stored payload is missing comes back with null payload, length, digest and (responses) bytes, not verified.
A null id has no id field and sorts below all others; ids of text are written percent-encoded. In addresses, blanks and
control characters are percent-encoded, each by its own code; a null leaves the field out. An empty table gives an empty
archive. Only id, address and payload are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, read_table, shared_dir, ship, spread_join

LEAST = 1000
#: Addresses that are broadcast with what is known of their payloads, or with payloads under ``LEAST`` bytes.
ADDRESSES = 20_000
DATE = "2024-01-01T00:00:00Z"
_NL = "\r\n"


def _record_id(name: Column) -> Column:
    """A name-based identifier of the page, the same on every run."""
    h = F.sha2(F.concat(F.lit("page:"), name).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))


def _escaped(url: Column) -> Column:
    """Blanks and control characters as percent and their code."""
    out = url
    for code in (*range(33), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.rlike(url, F.lit(r"[\x00-\x20\x7F]")), out).otherwise(url)


def _header(record_type: Column, name: Column, url: Column, sha1: Column, size: Column, refers: Column) -> Column:
    """Everything of a record before its payload: WARC fields, then the HTTP head that its block begins with."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(_NL + _NL))
    revisit = record_type == "revisit"
    fields = F.concat_ws(
        _NL,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(name)),
        F.concat(F.lit("X-Page-ID: "), F.url_encode(name)),
        F.concat(F.lit("WARC-Target-URI: "), _escaped(url)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(refers))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.url_encode(refers))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string")),
    )
    return F.concat(fields, F.lit(_NL + _NL), http).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> None:
    """Write the tables ``payloads`` and ``records`` under ``path``."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("address"))
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The aggregation deals addresses as buckets do, so each bucket is one file, of the task that has it.
    stored = rows.groupBy("address").agg(F.first("payload").alias("payload"), F.max("id").alias("last_id"), F.count("*").alias("n"))
    name = _table_name()
    stored.write.format("parquet").option("compression", "zstd").option("path", f"{path}/payloads").bucketBy(buckets, "address").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(_listed(stored)).alias("columns")).write.parquet(f"{path}/layout")
    known = _stored(spark, path).select("address", "last_id", "n", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    text_of = lambda c: F.col(c).cast("string")
    kind = F.when((F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("last_id")), "revisit").otherwise("response")
    records = spread_join(rows.select("id", "url", "address"), known, "address", "n", F.col("id"), ADDRESSES).withColumn("record_type", kind)
    records = records.select("address", F.col("n").alias("n_address"), _header(F.col("record_type"), text_of("id"), F.col("url"), F.col("sha1"), F.col("size"), text_of("last_id")).alias("header"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def _table_name() -> str:
    return f"warc_{uuid.uuid4().hex}"


def _listed(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, read by their buckets."""
    layout, name = spark.read.schema("buckets int, columns string").parquet(f"{path}/layout").first(), _table_name()
    buckets, listed = layout["buckets"], layout["columns"] or _listed(spark.read.parquet(f"{path}/payloads"))  # without payloads there may be no file
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({listed}) USING parquet CLUSTERED BY (address) INTO {buckets} BUCKETS LOCATION '{place}/payloads'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # what was found keeps files and buckets; the catalog keeps nothing
    return found


def _field(header: Column, name: str) -> Column:
    return F.when(F.contains(header, F.lit(f"\n{name}: ")), F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)", 1))


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """id, record_type, url, payload_digest (SHA-1), payload_bytes, refers_to, verified, payload (null for revisits), record (all its bytes), from the stored tables."""
    stored = _stored(spark, path)
    about = (F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), (F.sha2("payload", 256) == F.col("address")).alias("intact"))
    text = F.col("header").cast("string")
    heads = spark.read.parquet(f"{path}/records").select("address", "n_address", "header", _field(text, "WARC-Type").alias("record_type"))
    responses, revisits = heads.filter("record_type = 'response'"), heads.filter("record_type != 'response'")
    hot = F.col("n_address") > HOT_ROWS  # of responses: payloads under ``least`` bytes, since longer ones have one response
    wide = stored.select("address", "payload", *about)
    whole = responses.filter(~hot).join(wide, "address", "left").unionByName(spread_join(responses.filter(hot), stored.filter(F.col("n") > HOT_ROWS).select("address", "payload", *about, "n"), "address", "n", F.col("header"), ADDRESSES).drop("n"))
    named = spread_join(revisits, stored.select("address", *about, "n"), "address", "n", F.col("header"), ADDRESSES).drop("n").withColumn("payload", F.lit(None).cast("binary"))
    both = whole.unionByName(named).withColumn("record", F.concat("header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")))
    id_of = lambda name: F.url_decode(_field(text, name)).cast(id_type)
    return both.select(
        id_of("X-Page-ID").alias("id"), "record_type", _field(text, "WARC-Target-URI").alias("url"), "payload_digest", "payload_bytes",
        F.when(F.col("record_type") == "revisit", id_of("X-Refers-To-Page-ID")).alias("refers_to"),
        F.coalesce(F.col("intact") & (_field(text, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit(False)).alias("verified"), "payload", "record",
    )


def write_files(archive: DataFrame, path: str, records_per_file: int = 5000) -> None:
    """Write the records of ``read_archive`` as WARC files; payloads must be UTF-8. A record's closing blank lines end its row."""
    body = F.col("record").cast("string")
    archive.select(F.substring(body, F.lit(1), F.length(body) - 4).alias("value")).write.option("lineSep", _NL + _NL).option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for raw in pdf["content"]:
            at, out = 0, []
            while at < len(raw):
                end = raw.index(b"\r\n\r\n", at)
                fields = dict(x.split(": ", 1) for x in raw[at:end].decode().split(_NL)[1:])
                block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
                out.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"], fields.get("WARC-Refers-To"), block.partition(b"\r\n\r\n")[2]))
                at = end + 8 + len(block)
            yield pd.DataFrame(out, columns=["record_id", "record_type", "url", "digest", "refers_to", "payload"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_id, record_type, url, digest, refers_to, payload (empty for revisits). A file is parsed whole."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_parsed, "record_id string, record_type string, url string, digest string, refers_to string, payload binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, rebuilt by joining header and payload, and what its bytes say; ``record_bytes`` and ``record_sha256`` are of the whole record."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = read_table(spark, sf_dir, "pages")
    write_archive(pages, path)
    back = read_archive(spark, path, dict(pages.dtypes)["page_id"])
    return back.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "verified",
        F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"),
    )


#: The records are made again here, byte by byte, from the pages.
OP6_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, html, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last_id FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type FROM d),
h AS (SELECT *, sha256('page:' || page_id) AS a, sha256('page:' || last_id) AS b,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || payload_bytes || chr(13) || chr(10) || chr(13) || chr(10) AS http FROM r),
f AS (SELECT *, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || record_type,
    'WARC-Record-ID: <urn:uuid:' || a[1:8] || '-' || a[9:12] || '-5' || a[14:16] || '-8' || a[18:20] || '-' || a[21:32] || '>', 'X-Page-ID: ' || page_id, 'WARC-Target-URI: ' || url, 'WARC-Date: 2024-01-01T00:00:00Z', 'WARC-Payload-Digest: sha1:' || payload_digest,
    CASE WHEN record_type = 'revisit' THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
    CASE WHEN record_type = 'revisit' THEN 'WARC-Refers-To: <urn:uuid:' || b[1:8] || '-' || b[9:12] || '-5' || b[14:16] || '-8' || b[18:20] || '-' || b[21:32] || '>' END,
    CASE WHEN record_type = 'revisit' THEN 'X-Refers-To-Page-ID: ' || last_id END,
    'Content-Type: application/http;msgtype=response', 'Content-Length: ' || (strlen(http) + CASE WHEN record_type = 'revisit' THEN 0 ELSE payload_bytes END)) || chr(13) || chr(10) || chr(13) || chr(10) || http || CASE WHEN record_type = 'revisit' THEN '' ELSE html END || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM h)
SELECT page_id, payload_bytes, payload_digest, record_type, CASE WHEN record_type = 'revisit' THEN last_id END AS refers_to, true AS verified, strlen(record) AS record_bytes, sha256(record) AS record_sha256 FROM f
"""
