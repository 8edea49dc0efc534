"""WARC archives as a table of chunks.

A payload is never held as one record: it is cut into chunks of bounded size, each a
row (record, chunk number, bytes) with the SHA-1 of the record so far, and each
written as a WARC segment of its own (``WARC-Segment-Number``). Reading turns the
archives back into the chunk table and streams the chunks of a record through one
SHA-1, so neither side needs memory for more than a chunk beside the given rows.

A chunk never holds the mark that opens a record, since it is cut inside that mark;
so a reader may split an archive at the mark alone. Archives are gzip files, which
Spark reads whole and in order, one task a file.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the
largest page_id is the response and the others are revisits of it; a row that
repeats both page_id and payload is of the same type. Null payloads are empty, null
urls are left out, and null ids are never the largest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import utf8
from pairforge.runtime import durable

REVISIT_BYTES = 1000
CHUNK_BYTES = 1 << 18
BATCH_BYTES = 4 << 20

MARK = "WARC/1.1\r\n"  # opens every record
_CRLF = "\r\n"
_DATE = "2024-01-01T00:00:00Z"
_BYTES_MARK = MARK.encode()


def chunk_spans(payload: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a UTF-8 payload, one at least.

    Chunks end between characters and inside every mark.
    """
    start, n = 0, len(payload)
    while True:
        end = min(start + size, n)
        while start < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        if end == start and n > start:  # not UTF-8 at all
            end = min(start + size, n)
        found = payload.find(_BYTES_MARK, start, end)
        if found >= 0:
            end = found + 4
        yield start, end
        start = end
        if start >= n:
            return


def _record_id(page: Column, digest: Column) -> Column:
    """A stable identifier of (page, payload) in the form of a UUID."""
    h = F.md5(F.concat(F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def planned(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html) with digest, size, record id, type and what a revisit refers to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    # Minima of digests met once need no look-up, so the joined table holds copies only.
    chosen = (
        rows.filter(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.reverse("digest").alias("_k"), "kept")
    )
    joined = rows.withColumn("_k", F.reverse("digest")).join(chosen, "_k", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("html")).alias("html"),
        "digest",
        "size",
        _record_id(F.col("page_id"), F.col("digest")).alias("record"),
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, _record_id(F.col("kept"), F.col("digest"))).alias("refers"),
    )


CHUNKS = "record string, chunk int, head string, payload binary, digest_so_far string"


def chunk_table(plan: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of planned records, in order: header lines, bytes, and the digest so far."""

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        weight = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(held, kinds, strict=True)],
                ["record", "chunk", "head", "payload", "digest_so_far"],
            )
            for c in held:
                c.clear()
            return out

        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            payloads = utf8(batch.column(at["html"]))
            for i in range(batch.num_rows):
                row = {n: batch.column(at[n])[i].as_py() for n in ("page_id", "url", "digest", "size", "record", "type", "refers")}
                view = payloads[i].as_buffer()
                payload, sha, total = memoryview(view) if view.size else memoryview(b""), hashlib.sha1(), row["size"]
                spans = [(0, 0)] if row["type"] == "revisit" else chunk_spans(view.to_pybytes() if view.size else b"", size)
                for number, (start, end) in enumerate(spans, 1):
                    part = payload[start:end]
                    sha.update(part)
                    values = (row["record"], number, _head(row, number, end - start, end >= total), bytes(part), sha.hexdigest())
                    for column, value in zip(held, values, strict=True):
                        column.append(value)
                    weight += end - start
                    if weight >= BATCH_BYTES or len(held[0]) >= 10_000:
                        yield flush()
                        weight = 0
        yield flush()

    return plan.mapInArrow(run, CHUNKS)


def _http(size: int) -> str:
    return _CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""])


def _head(row: dict, number: int, length: int, last: bool) -> str:
    """Header lines of one segment, without the opening mark, with the empty line after them."""
    kind = row["type"] if number == 1 else "continuation"
    first = _http(row["size"]) if number == 1 and kind == "response" else ""
    name = row["record"] if number == 1 else f"{row['record']}:{number}"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~"))
    if number == 1:
        page = "-" if row["page_id"] is None else row["page_id"]
        lines += [f"X-Page-ID: {page}", f"WARC-Payload-Digest: sha1:{row['digest']}"]
    if row["type"] == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{row['refers']}>",
        ]
    elif number > 1:
        lines.append(f"WARC-Segment-Origin-ID: <{row['record']}>")
    if number > 1 or not last:
        lines.append(f"WARC-Segment-Number: {number}")
    if number > 1 and last:
        lines.append(f"WARC-Segment-Total-Length: {row['size'] + len(_http(row['size']))}")
    if kind != "revisit":
        lines.append("Content-Type: application/http;msgtype=response")
    lines += [f"Content-Length: {len(first) + length}", "", ""]
    return _CRLF.join(lines) + first


def write_archives(pages: DataFrame, path: str, size: int = CHUNK_BYTES) -> None:
    """One WARC record for every row, as gzip files in a folder."""
    record = F.concat(F.lit(MARK), "head", F.col("payload").cast("string"), F.lit(_CRLF))
    (
        chunk_table(planned(pages), size)
        .select(record.alias("value"))
        .write.option("lineSep", _CRLF)
        .option("compression", "gzip")
        .text(path)
    )


_FIELD = re.compile(rb"^([A-Za-z-]+): (.*?)\r?$", re.M)


def _parse(record: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields and block of one record without its opening mark."""
    head, found, rest = record.partition(b"\r\n\r\n")
    fields = dict(_FIELD.findall(head))
    length = int(fields.get(b"Content-Length", b"-1"))
    if not found or length < 0 or len(rest) < length:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:length]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: (record, chunk, type, page_id, refers, declared, payload), in file order."""
    lines = spark.read.option("lineSep", MARK).text(path).filter(F.col("value") != "")

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for raw in utf8(batch.column(0)).to_pylist():
                fields, block = _parse(raw)
                kind = fields[b"WARC-Type"].decode()
                number = int(fields.get(b"WARC-Segment-Number", b"1"))
                record = fields.get(b"WARC-Segment-Origin-ID", fields[b"WARC-Record-ID"]).decode()[1:-1]
                if kind == "response":
                    block = block.partition(b"\r\n\r\n")[2]
                page = fields.get(b"X-Page-ID", b"-")
                refers = fields.get(b"WARC-Refers-To")
                declared = fields.get(b"WARC-Payload-Digest")
                values = (
                    record,
                    number,
                    kind,
                    None if page == b"-" else int(page),
                    refers and refers.decode()[1:-1],
                    declared and declared.decode().removeprefix("sha1:"),
                    block,
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["record", "chunk", "type", "page_id", "refers", "declared", "payload"],
            )

    return lines.mapInArrow(
        run,
        "record string, chunk int, type string, page_id long, refers string, declared string, payload binary",
    )


RECORDS = "record string, type string, page_id long, refers string, size long, digest string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: type, page, size and digest, checked against the declared digest.

    The chunks of a record stand one after the other in one file, and pass through
    one SHA-1; a gap or a wrong digest fails the job.
    """

    def run(batches):
        row, sha = None, None
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                number = batch.column(1)[i].as_py()
                if number == 1:
                    if row:
                        out.append(_closed(row, sha))
                    row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names) if n != "payload"}
                    row |= {"size": 0, "chunk": 0}
                    sha = hashlib.sha1()
                if row is None or row["record"] != batch.column(0)[i].as_py() or row["chunk"] + 1 != number:
                    raise ValueError("segments of a WARC record are missing or out of order")
                buffer = batch.column(6)[i].as_buffer()
                row["chunk"], row["size"] = number, row["size"] + buffer.size
                sha.update(buffer)
            yield _record_batch(out)
        yield _record_batch([_closed(row, sha)] if row else [])

    return read_chunks(spark, path).mapInArrow(run, RECORDS)


def _closed(row: dict, sha) -> tuple:
    if row["type"] == "revisit":
        return row["record"], "revisit", row["page_id"], row["refers"], None, row["declared"]
    if sha.hexdigest() != row["declared"]:
        raise ValueError(f"the payload of {row['record']} does not have its declared digest")
    return row["record"], row["type"], row["page_id"], None, row["size"], row["declared"]


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
        ["record", "type", "page_id", "refers", "size", "digest"],
    )


def resolved(records: DataFrame) -> DataFrame:
    """Records with the size of what a revisit refers to, and that page's id.

    The records are looked at three times, so they are written down once; they hold no
    payloads.
    """
    records = durable(records, "records")
    kept = (
        records.filter("type = 'response'")
        .groupBy(F.reverse("record").alias("_k"))
        .agg(F.min("page_id").alias("of"), F.min("size").alias("of_size"))
    )
    own = records.withColumn("_k", F.reverse("refers"))
    revisits = own.filter("type = 'revisit'").join(kept, "_k", "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = own.filter("type <> 'revisit'").select(
        "page_id", F.col("size"), F.col("digest"), F.col("type"), F.lit(None).cast("long")
    )
    return responses.toDF(*columns).unionByName(
        revisits.select("page_id", "of_size", "digest", "type", "of").toDF(*columns)
    )
