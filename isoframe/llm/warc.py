"""WARC archives: one gzip member per record, written and read back by Spark tasks.

Archives are files in the shared folder of the session; each task opens its own through the file
system that the folder's address names. The reader decompresses piece by piece, frames blocks by
Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, written

#: An archive is closed once it holds so many bytes, so files stay of bounded size.
ROLL_BYTES = 64 << 20
PIECE = 1 << 16
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _open(address: str):
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address[len("file:") :]
    return pafs.FileSystem.from_uri(address)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header_safe(value: str) -> str:
    """Line ends and the escape sign itself as %XX, so that any value fits a header line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _header_value(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record_bytes(page_id, url, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head, which states the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{_base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(url)}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def gzip_members(stream) -> Iterator[bytes]:
    """The decompressed bytes of each gzip member of a stream, read and unpacked piece by piece."""
    pending = b""
    while True:
        pending = pending or stream.read(PIECE)
        if not pending:
            return
        unpacker, out = zlib.decompressobj(31), bytearray()
        while not unpacker.eof:
            if not pending:
                pending = stream.read(PIECE)
                if not pending:
                    raise ValueError("archive ends inside a gzip member")
            out += unpacker.decompress(pending)
            pending = unpacker.unused_data
        yield bytes(out)


def parse_record(data: bytes) -> dict:
    """Head fields, payload and digest checks of one record."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    head = dict(line.split(": ", 1) for line in lines)
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("record does not have the length it states")
    if f"sha1:{_base32(hashlib.sha1(block).digest())}" != head["WARC-Block-Digest"]:
        raise ValueError("block digest does not match")
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[: cut - 4].decode().split("\r\n")[1:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[cut:] if head["WARC-Type"] == "response" else None
    if payload is not None and _base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError("payload digest does not match")
    return {
        "page_id": int(head["Page-Id"]) if "Page-Id" in head else None,
        "url": _header_value(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None,
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": digest,
        "record_type": head["WARC-Type"],
        "refers_to": int(head["Refers-To-Page"]) if "Refers-To-Page" in head else None,
        "payload": payload,
    }


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives; returns (path, records, bytes) per archive.

    Null html is an empty payload. Of equal payloads of at least ``min_revisit_bytes`` bytes that of
    the smallest page_id is a response and rows of other page_ids are revisits; rows that repeat the
    smallest page_id are responses too, and a null page_id never is the one referred to. A task that
    runs again writes new files and only those of the finished attempt are listed.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Counted before the shuffle: a payload that a third of the pages share sends one row per task.
    firsts = (
        rows.where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    marked = rows.join(firsts, ["digest", "size"], "left").select(
        "page_id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )
    folder = shared_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, records, size = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return written(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives listed in column ``path``; damaged records fail the task with their reason."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if with_payload else ""
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    types |= {"payload": pa.binary()} if with_payload else {}
    fields = pa.schema(list(types.items()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                fs, path = _open(address)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for member in gzip_members(stream):
                        rows.append({k: v for k, v in parse_record(member).items() if k in types})
                        if len(rows) >= (64 if with_payload else 2048):
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)

    # As many tasks as archives, within reason; each archive is read from front to end by one of them.
    spread = max(1, min(archives.count(), 100_000))
    return archives.select("path").repartition(spread).mapInArrow(read, schema)


def op9_query(spark, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31 AS INT) + 1, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)
OP9_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, n, min(page_id) AS first FROM q GROUP BY h, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q JOIN f USING (h, n)
"""
