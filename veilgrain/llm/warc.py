"""WARC writing and index-first reading.

Writing: every task packs its rows into gzip-per-record WARC/1.1 files of about
``FILE_BYTES`` in a shared folder and returns one index row per record (file,
offset, length, URL, payload digest). A task that is retried writes files of
another name, and the stored index names only those of the attempt that
counted, so lost executors leave at most unreferenced files.

Reading: the records wanted are index rows. They are range-partitioned and
sorted by (file, offset), as many partitions as their bytes fill, so each task
sees neighbours together, coalesces their byte ranges (gaps up to ``GAP``, reads
up to ``READ_BYTES``) and parses the records out of each read.

Python workers open the archives' folder by its URI. Names that Hadoop has for
object stores (``s3a``, ``wasbs`` and the like) are turned into those pyarrow
has; for any other store pass ``open_store``, which makes a pyarrow file system
and a path of the folder's URI.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
largest page_id is the response; the others are revisits of it without a block.
Equality is decided on SHA-256 before anything is written; only digests held by
more than one row are joined back, so texts move only if those are many.

Defined cases: a null payload is the empty one; a null page_id is smallest, is
written as an empty id, and rows that repeat the response's id are responses
too; null URLs are written as an empty target. Payloads are of any length.
An empty table writes no archive and reads as one; repeated rows are records of
their own; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm.common import text_or_empty
from veilgrain.workspace import Workspace, read_table

FILE_BYTES = 64 << 20
READ_BYTES, GAP = 8 << 20, 64 << 10
#: Bytes of archives that one task should read.
TASK_BYTES = 256 << 20
LEVEL = 3
#: A fixed date keeps archives of the same rows alike.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, digest: str) -> bytes:
    """One WARC record, not compressed. ``response_id``: of the response that this one revisits, else None."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response_id is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if response_id is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head += ["Content-Type: application/http; msgtype=response", f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{response_id}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _named_id(field: str | None) -> int | None:
    inner = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def parse(raw: bytes) -> dict:
    """The fields of one record and, for a response, its payload; its digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    return {
        "page_id": _named_id(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": _named_id(fields.get("WARC-Refers-To")),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


# Hadoop's names of object stores, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def open_uri(folder: str):
    """File system and path of a shared folder, in a Python worker."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest if colon else folder)


def write_archives(
    pages: DataFrame, folder: str, ws: Workspace, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    open_store: Callable = open_uri,
) -> DataFrame:
    """Write ``pages`` below ``folder``; the stored index, one row per record."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(payload_col).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    shared = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    shared = ws.write(shared.filter("n > 1").select("sha", "keep"), "shared_payloads")
    rows = rows.join(shared, "sha", "left").select("page_id", "url", "html", "keep")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        file, out, at = "", None, 0
        for batch in batches:
            index = []
            for page_id, url, html, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{file}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                other = keep if keep is not None and keep != page_id else None
                packed = _gzip(record(page_id, url, payload, other, digest))
                out.write(packed)
                index.append((page_id, url, "response" if other is None else "revisit", other, digest, len(payload), file, at, len(packed)))
                at += len(packed)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), schema, strict=True)], schema=schema)
        if out is not None:
            out.close()

    return ws.write(rows.mapInArrow(run, INDEX), "index")


def coalesced(wanted: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) merged into reads (file, start, end, their ranges) as they come."""
    file, start, end, held = "", 0, 0, []
    for name, offset, length in wanted:
        if held and (name != file or offset - end > gap or offset + length - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = name, offset, offset
        end = max(end, offset + length)
        held.append((offset, length))
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, folder: str, with_payload: bool = True, open_store: Callable = open_uri) -> DataFrame:
    """The records that ``index`` names, parsed and checked; any subset of the index will do."""
    wanted = index.select("file", "offset", "length")
    size = wanted.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    wanted = wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        name, source = "", None
        for file, start, end, ranges in coalesced(rows):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, store.open_input_file(f"{base}/{file}")
            source.seek(start)
            raw = source.read(end - start)
            found = [parse(zlib.decompress(raw[at - start : at - start + length], 31)) for at, length in ranges]
            if not with_payload:
                for f in found:
                    f["payload"] = None
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)], names=names)
        if source is not None:
            source.close()

    return wanted.mapInArrow(run, RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op3")
    folder = f"{ws.path}/warc"
    index = write_archives(read_table(spark, sf_dir, "pages"), folder, ws)
    found = read_records(index, folder, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_PAYLOAD = "coalesce(html, '')"
_FIVE_BITS = "CAST('0x' || substr(sha1(p), (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4)) & 31"
ORACLE = f"""
WITH t AS (SELECT page_id, {_PAYLOAD} AS p, max(page_id) OVER (PARTITION BY {_PAYLOAD}) AS keep FROM pages)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_FIVE_BITS}) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep OR keep IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep OR keep IS NULL THEN NULL ELSE keep END AS refers_to
FROM t
"""
