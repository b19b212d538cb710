"""WARC archives with revisit resolution.

Headers (id, address, payload digest, size) are shuffled by digest, where partial aggregation keeps one
row for each digest and task; of the records with equal payloads the smallest id is the original. Records
are then joined to the originals and written as archives with fresh headers: a `response` holds the payload,
a `revisit` only the HTTP headers and a reference to its original (its record, address and date). Reading goes by Content-Length, as any
WARC reader would, and checks each payload against its digest; an archive is streamed, so that no more than one record of it
is held, whatever its size. About ARCHIVE_BYTES of payload go into an archive on average.

The originals of digests that occur more than once are broadcast if there are at most BROADCAST_ROWS of
them; beyond that the join is by (digest, salt) with each of them repeated for every salt, so that a
payload that a third of all pages have is spread over SALTS tasks and more by AQE.

Null html counts as empty, null url as empty, line breaks in an address become spaces. A null id is
never an original if another page has the payload; several rows with the smallest id are all responses.
An empty table writes no record and reads back as empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventloom.llm.common import cut, ship

BROADCAST_ROWS, SALTS = 100_000, 16
#: Bytes of payload that an archive has on average at most, and its most records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32 << 20, 20_000
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, in Spark expressions: 40 bits are eight characters."""
    digest = F.sha1(payload)
    out = []
    for part in range(4):
        number = F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(_BASE32), F.shiftright(number, shift).bitwiseAND(31).cast("int") + F.lit(1), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*out)


def resolve(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """id, url, payload, digest, size, and original, original_url (null for responses) of each page."""
    digest = base32_sha1(F.coalesce(pages[payload], F.lit("")))
    rows = pages.select(pages[key].cast("long").alias("id"), F.coalesce(pages[url], F.lit("")).alias("url"), F.coalesce(pages[payload], F.lit("")).alias("payload"), digest.alias("digest")).withColumn("size", F.octet_length("payload").cast("long"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))  # of rows with the smallest id, the first address
    found = (
        rows.where(F.col("size") >= least).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", F.col("first.id").alias("original"), F.col("first.url").alias("original_url"))
    )
    found = cut(found)
    if found.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(found), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS))
        joined = rows.withColumn("salt", salt).join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["digest", "salt"], "left").drop("salt")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original")) & (F.col("size") >= least)
    return joined.withColumns({"original": F.when(revisit, F.col("original")), "original_url": F.when(revisit, F.col("original_url"))})


def record(date: str = "2024-01-01T00:00:00Z") -> Column:
    """The text of a record of `resolve`'s rows, but for the two line breaks that end it."""
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    address = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("size").cast("string")), F.lit(CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", address("url")),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        F.when(
            revisit,
            F.concat(line("WARC-Refers-To", urn(F.col("original"))), line("WARC-Refers-To-Target-URI", address("original_url")), line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(PROFILE))),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("size")).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(resolved: DataFrame, path: str) -> None:
    """Gzipped archives below path, written by Spark's text writer: values are the records, the line separator what ends a record."""
    mean = resolved.agg(F.avg("size")).first()[0] or 0.0
    each = int(max(1, min(ARCHIVE_RECORDS, ARCHIVE_BYTES // (mean + 1024))))
    resolved.select(record().alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    held = bytearray()

    def want(n: int) -> bool:
        while len(held) < n:
            more = next(stream, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while True:
            while held.startswith(b"\r\n"):  # blank lines between records
                del held[:2]
            if (end := held.find(b"\r\n\r\n")) >= 0:
                break
            if not want(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends inside a header")
                return
        lines = bytes(held[:end]).decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        del held[: end + 4]
        size = int(headers["content-length"])
        if not want(size + 4) or held[size : size + 4] != b"\r\n\r\n":
            raise ValueError("an archive ends inside a record")
        yield headers, bytes(held[:size])
        del held[: size + 4]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url; and payload (null for revisits) if asked for."""
    ship(spark)
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + (", payload binary" if payloads else "")
    try:
        # what stands between blank lines, in the order of each archive: put together again, it is the archive
        pieces = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    number = lambda urn: int(urn[len(URN) + 1 : -1]) if urn and len(urn) > len(URN) + 2 else None

    def parsed(stream: Iterator[bytes]) -> Iterator[dict]:
        for headers, block in records(stream):
            head, _, body = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
            if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its header")
            row = {"page_id": number(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(headers.get("warc-refers-to")), "url": headers.get("warc-target-uri", "")}
            yield row | ({"payload": body if kind == "response" else None} if payloads else {})

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())] + ([("payload", pa.binary())] if payloads else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (piece.encode() + b"\r\n\r\n" for batch in batches for piece in batch.column(0).to_pylist())
        held, size = [], 0
        for row in parsed(stream):
            held.append(row)
            size += row["payload_bytes"]
            if len(held) >= 5000 or payloads and size > 8 << 20:
                yield pa.RecordBatch.from_pylist(held, pa.schema(fields))
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, pa.schema(fields))

    return pieces.mapInArrow(run, schema)
