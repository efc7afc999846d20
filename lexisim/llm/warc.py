"""WARC archives: writing with revisits, segments and chunked framing; reading with reassembly.

``write`` gives one record per page: a ``response`` for the page with the
smallest id among equal payloads of ``least`` bytes or more, a ``revisit`` for
the others. A response block larger than ``segment`` bytes is split into a
first record and ``continuation`` records that name their origin. ``read``
parses each archive once, whole records where they are; it groups continuations
by origin, orders them by segment number, verifies numbers and total length,
and decodes the chunked transfer framing.

The archives are gzip files written and read by Spark's own file sources, so
any file system that Spark knows will do. A file holds ``PER_FILE`` records of
bounded size and is parsed as a stream.

Defined cases: a null payload is empty; a null ``page_id`` sorts after all
others and reads back as null; of rows that repeat both id and payload one is
the response (the smallest URL, null first) and the others revisit it; an
empty table gives archives without records; other columns are not written.
A damaged record raises ``ValueError`` in the task that meets it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, drop_path, materialise, new_path

#: Bytes of a block in one record; bytes of an HTTP chunk; records of a file.
SEGMENT, CHUNK, PER_FILE = 4 << 10, 8 << 10, 2000
#: Marks a null page id in record identifiers; larger than any id that sorts before it.
_LAST = (1 << 63) - 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BATCH = 4 << 20


def _chunked(payload: bytes) -> bytes:
    pieces = [payload[k : k + CHUNK] for k in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in pieces) + b"0\r\n\r\n"


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def _identifier(page: int | None, digest: str, more: str = "") -> str:
    return f"<urn:lexisim:page:{'null' if page is None else page}:{digest}{more}>"


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _write_rows(segment: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page, url, html, digest, first, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, digest, n = (html or "").encode(), base64.b32encode(bytes.fromhex(digest)).decode(), n + 1
                fields = [("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if first is False:
                    own = _identifier(page, digest, f":{part}.{n}")
                    fields += [("WARC-Record-ID", own), ("WARC-Refers-To", _identifier(None if of == _LAST else of, digest)), ("WARC-Profile", _PROFILE), ("Content-Type", "application/http; msgtype=response")]
                    out.append(_record("revisit", fields, _HTTP))
                else:
                    own = _identifier(page, digest, f":{part}.{n}" if first is None else "")
                    block = _HTTP + _chunked(payload)
                    fields += [("WARC-Record-ID", own), ("Content-Type", "application/http; msgtype=response")]
                    if len(block) <= segment:
                        out.append(_record("response", fields, block))
                    else:
                        pieces = [block[k : k + segment] for k in range(0, len(block), segment)]
                        out.append(_record("response", [*fields, ("WARC-Segment-Number", 1)], pieces[0]))
                        for k, piece in enumerate(pieces[1:], 2):
                            more = [("WARC-Record-ID", own[:-1] + f":s{k}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k)]
                            out.append(_record("continuation", more + [("WARC-Segment-Total-Length", len(block))] * (k == len(pieces)), piece))
                size += len(payload) + 500
                if size >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return write


def _with_roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest, first (null: too small to be looked up) and of (the response's id)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), (F.octet_length(html) >= least).alias("_large"))
    order = F.coalesce("page_id", F.lit(_LAST))
    # Counts are summed by digest and id before the shuffle; a hot payload is a few rows here.
    ids = rows.where("_large").groupBy("digest", order.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    copies = ids.groupBy("digest").agg(F.min("k").alias("of"), F.min_by("n", "k").alias("_tied"), F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    copies = materialise(copies, "copies")
    rows = rows.join(copies, "digest", "left").withColumn("first", F.when(F.col("_large"), F.col("of").isNull() | (F.col("of") == order)))
    if not copies.where("_tied > 1").isEmpty():  # rows that repeat an id and its payload: number them
        tied = F.col("first") & (F.coalesce("_tied", F.lit(1)) > 1)
        alone = rows.where(~F.coalesce(tied, F.lit(False)))
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
        rows = alone.unionByName(rows.where(tied).withColumn("first", nth == 1))
    return rows.select("page_id", "url", "html", "digest", "first", "of")


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) as ``*.gz`` archives into the new folder ``path``."""
    if least > segment:
        raise ValueError("least must not exceed segment")
    bound_batches(pages.sparkSession)
    records = _with_roles(pages, least).mapInArrow(_write_rows(segment), "value binary")
    # A record ends in two line ends: exactly what the text source puts after each row.
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


_PARSED = "kind string, id string, page_id long, refers_id string, refers_to long, digest string, origin string, number int, total long, body binary"


def _page_in(identifier: str | None) -> int | None:
    said = identifier.split(":")[3] if identifier else "null"
    return None if said == "null" else int(said)


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not start with its version")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.lower()] = v.strip()
        block = stream.read(n := int(fields["content-length"]))
        if len(block) != n:
            raise ValueError("a record is shorter than its Content-Length")
        yield fields, block


def _payload(block: bytes, digest: str | None) -> bytes:
    """The payload in an HTTP block, checked against the record's SHA-1."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = _unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload does not have its digest")
    return payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.string()), ("id", pa.string()), ("page_id", pa.int64()), ("refers_id", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("body", pa.binary())])
    out, size = [], 0
    for batch in batches:
        for content in batch.column(0):
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as packed, io.BufferedReader(packed, 1 << 17) as stream:
                for f, block in _records(stream):
                    kind, own, refers = f["warc-type"], f["warc-record-id"], f.get("warc-refers-to")
                    number = f.get("warc-segment-number")
                    origin = f.get("warc-segment-origin-id") or (own if number else None)
                    digest = (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    body = block if origin else _payload(block, digest) if kind == "response" else None
                    out.append((kind, own, _page_in(own), refers, _page_in(refers), digest, origin, number and int(number), (t := f.get("warc-segment-total-length")) and int(t), body))
                    size += len(block) + 300
                    if size >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifies and joins the ordered segments of each origin, and decodes the payload."""
    for batch in batches:
        done = []
        for total, digest, parts in zip(batch.column("total").to_pylist(), batch.column("digest").to_pylist(), batch.column("parts"), strict=True):
            parts = parts.as_py()
            if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError("segments are missing or repeated")
            block = b"".join(p["body"] for p in parts)
            if len(block) != total:
                raise ValueError("segments do not have the total length")
            done.append(_payload(block, digest))
        keep = [batch.column(c) for c in ("id", "page_id", "digest")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(done, pa.binary())], ["id", "page_id", "digest", "payload"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes and payload of each page in the archives.

    A revisit's payload stays with its response (null here); its length is looked up there by record identifier.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = materialise(files.mapInArrow(_parse, _PARSED), "records")
    whole = parsed.where("kind = 'response' and origin is null").select("id", "page_id", "digest", F.col("body").alias("payload"))
    parts = parsed.where("origin is not null").groupBy("origin").agg(
        F.first("id", True).alias("_any"), F.max(F.when(F.col("kind") == "response", F.col("page_id"))).alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("number", "body"))).alias("parts"),
    )
    parts = parts.select(F.col("origin").alias("id"), "page_id", "digest", "total", "parts").mapInArrow(_rejoin, "id string, page_id long, digest string, payload binary")
    full = whole.unionByName(parts).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = parsed.where("kind = 'revisit'").select("page_id", "refers_id", "refers_to", "digest")
    sizes = full.select(F.col("id").alias("refers_id"), "payload_bytes")
    responses = full.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.col("digest").alias("payload_digest"), "payload_bytes", "payload")
    again = revisits.join(sizes, "refers_id", "left").select("page_id", F.lit("revisit").alias("record_type"), "refers_to", F.col("digest").alias("payload_digest"), "payload_bytes", F.lit(None).cast("binary").alias("payload"))
    return responses.unionByName(again)


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least, segment)
    back = read(pages.sparkSession, path)
    drop_path(pages.sparkSession, path)  # its records are a table now
    return back
