"""WARC archives: written as request, response or revisit, and metadata records; read back by transaction.

Archives are gzip files in the Spark folder they are written to. Spark's text
writer ends every value with CRLF CRLF, which is the end of a WARC record, so
each row is one record and the writer's commit protocol covers the archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, scratch_path

CRLF = "\r\n"
MIN_REVISIT = 1000
#: Aim for the uncompressed bytes of one archive.
ARCHIVE_BYTES = 64 << 20
FIELDS = (
    "kind string, record_id string, concurrent_to string, refers_to string, uri string, page string, "
    "payload_bytes long, payload_digest string, stated_digest string, note string, payload binary"
)


def _uuid(c: Column) -> Column:
    h = F.md5(c)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of one record without its final CRLF CRLF; headers with a null value are left out."""
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Three records a page below ``path``.

    Of pages with equal payloads of at least 1,000 bytes the one with the
    largest id is the response, the others are revisits that name it. A null
    payload is empty; line ends in urls are percent-encoded. Pages without an
    id are responses unless a page with an id has the same payload.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = pages.select(
        F.col(id_col).alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("size"),
    )
    large = page.filter(F.col("size") >= MIN_REVISIT)
    shared = large.groupBy(F.col("digest").alias("_d")).agg(F.max("page").alias("top"), F.count("*").alias("_n")).filter("_n > 1 AND top IS NOT NULL").drop("_n")
    of = page.agg(F.count("*").alias("n"), F.sum(F.col("size") + 1500).alias("bytes")).first()
    per_file = max(3, 3 * ARCHIVE_BYTES * (of["n"] or 1) // max(1, of["bytes"] or 1))
    known = page.join(shared, (F.col("digest") == F.col("_d")) & (F.col("size") >= MIN_REVISIT), "left")
    again = F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))
    named = known.select(
        "*", again.alias("again"),
        F.expr("uuid()").alias("u"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("uri"),
    )
    response_id = lambda c: _uuid(F.concat(F.lit("response|"), c.cast("string")))
    request = F.concat(F.lit("<urn:uuid:"), F.col("u"), F.lit(">"))
    own = F.when(F.col("top").eqNullSafe(F.col("page")) & F.col("page").isNotNull(), response_id(F.col("page"))).otherwise(_uuid(F.concat("u", F.lit("response"))))
    common = [("WARC-Target-URI", F.when(F.col("uri") != "", F.col("uri"))), ("X-Page-Id", F.col("page").cast("string"))]
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2)
    )
    records = F.array(
        _record(F.lit("request"), request, [*common, ("Content-Type", F.lit("application/http;msgtype=request"))],
                F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF * 2}"))),
        _record(
            F.when(F.col("again"), "revisit").otherwise("response"), own,
            [*common, ("WARC-Concurrent-To", request), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
             ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
             ("WARC-Refers-To", F.when(F.col("again"), response_id(F.col("top")))), ("Content-Type", F.lit("application/http;msgtype=response"))],
            F.concat(head, F.when(F.col("again"), "").otherwise(F.col("html"))),
        ),
        _record(F.lit("metadata"), _uuid(F.concat("u", F.lit("metadata"))), [*common, ("WARC-Concurrent-To", request), ("Content-Type", F.lit("application/warc-fields"))],
                F.concat(F.lit("payload-bytes: "), F.col("size").cast("string"))),
    )
    named.select(F.explode(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", int(per_file)).text(path)


def _parse(content: bytes, payloads: bool) -> Iterator[tuple]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    while version := stream.readline():
        if not version.strip():
            continue
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        kind, body, size, digest, note = head["warc-type"], None, None, None, None
        if kind == "response":
            body = block[block.index(b"\r\n\r\n") + 4 :]
            size, digest = len(body), hashlib.sha1(body).hexdigest()
        elif kind == "metadata":
            note = block.decode("utf-8")
        stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield (
            kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
            head.get("x-page-id"), size, digest, stated, note, body if payloads else None,
        )


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; digests are taken from the stored payloads."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in _parse(content.as_py(), payloads):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page, uri, request, response, metadata, payload_bytes, payload_digest, refers_to_page.

    Response and metadata records find their request through WARC-Concurrent-To.
    A capture without one of its records has a null there. A revisit takes the
    size of its payload from the response it refers to.
    """
    part = lambda kinds: records.filter(F.col("kind").isin(kinds))
    asked = part(["request"]).select(F.col("record_id").alias("t"), "page", "uri", F.struct("record_id").alias("request"))
    answered = part(["response", "revisit"]).select(F.col("concurrent_to").alias("t"), F.struct("kind", "record_id", "refers_to", "payload_bytes", "payload_digest", "stated_digest", "payload").alias("response"))
    noted = part(["metadata"]).select(F.col("concurrent_to").alias("t"), F.struct("record_id", "note").alias("metadata"))
    target = part(["response"]).groupBy(F.col("record_id").alias("_to")).agg(
        F.max("page").alias("_page"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest")
    )
    whole = asked.join(answered, "t", "left").join(noted, "t", "left")
    revisits = part(["revisit"]).select(F.col("refers_to").alias("_to")).distinct()
    target = target.join(revisits, "_to", "left_semi")
    return whole.join(target, F.col("response.refers_to") == F.col("_to"), "left").select(
        "page", "uri", "request", "response", "metadata",
        F.coalesce(F.col("response.payload_bytes"), F.col("_bytes")).alias("payload_bytes"),
        F.coalesce(F.col("response.payload_digest"), F.col("_digest"), F.col("response.stated_digest")).alias("payload_digest"),
        F.col("_page").alias("refers_to_page"),
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from archives that are written and read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    captures = assemble(materialize(read_records(spark, path), "records"))
    kind = pages.schema[id_col].dataType
    return captures.select(
        F.col("page").cast(kind).alias("page_id"), F.col("payload_bytes"), "payload_digest",
        F.col("response.kind").alias("record_type"), F.col("refers_to_page").cast(kind).alias("refers_to"),
    )
