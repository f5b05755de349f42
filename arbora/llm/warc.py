"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, trained on the archive's
first records; every record is a frame of its own, compressed with that dictionary.  Records with equal payloads are
stored once: one is a response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import joined_by_key, new_path, written

#: Payload bytes from which copies are revisits.
REVISIT_BYTES = 1000
#: Bytes of a dictionary, bytes of records that it is trained on at most, and the fewest records that allow training.
DICTIONARY_BYTES, TRAINING_BYTES, TRAINING_RECORDS = 32_768, 1_000_000, 16
#: Compressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 128_000_000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record_bytes(ident: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given: the payload's HTTP header stays in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if ident is None else ident}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; empty where they are too few or too alike to train on."""
    if len(samples) < TRAINING_RECORDS:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def open_fs(uri: str):
    """(file system, path) of a folder given as URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("file:", "file://", 1))


class ArchiveWriter:
    """Writes records into archives of a folder; ``manifest`` lists (path, records, bytes) of the finished ones."""

    def __init__(self, folder: str):
        self.fs, self.folder = open_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.manifest: list[tuple[str, int, int]] = []
        self.waiting: list[bytes] = []
        self.held, self.out = 0, None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= TRAINING_BYTES:
                self._begin()
        else:
            self._put(record)

    def _begin(self) -> None:
        data = trained(self.waiting)
        params = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_checksum=True)
        self.compress = params.compress
        # a name of its own for every attempt of a task: what a lost attempt leaves isn't in any manifest
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.bytes = self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data) or 8 + len(data)
        self.records = 0
        waiting, self.waiting, self.held = self.waiting, [], 0
        for record in waiting:
            self._put(record)

    def _put(self, record: bytes) -> None:
        frame = self.compress(record)
        self.out.write(frame)
        self.bytes += len(frame)
        self.records += 1
        if self.bytes >= ARCHIVE_BYTES:
            self._end()

    def _end(self) -> None:
        self.out.close()
        self.manifest.append((self.path, self.records, self.bytes))
        self.out = None

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._begin()
        if self.out is not None:
            self._end()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, read as a stream."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    data = stream.read(size) if size else b""
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    with decompressor.stream_reader(stream, read_across_frames=True, closefd=False) as plain:
        rest = b""
        while True:
            while b"\r\n\r\n" not in rest:
                more = plain.read(1 << 16)
                if not more:
                    if rest.strip():
                        raise ValueError("the archive ends inside a record")
                    return
                rest += more
            head, _, rest = rest.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            need = int(headers["Content-Length"]) + 4
            parts, have = [rest], len(rest)
            while have < need:
                more = plain.read(max(1 << 16, need - have))
                if not more:
                    raise ValueError("the archive ends inside a record")
                parts.append(more)
                have += len(more)
            rest = b"".join(parts)
            block, rest = rest[: need - 4], rest[need:]
            yield headers, block


def with_revisits(pages: DataFrame, page: str, url: str, ident: str) -> DataFrame:
    """(id, url, html, sha1, refers_to): of the pages with one payload of REVISIT_BYTES at least, all but those with the
    largest id refer to it."""
    rows = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    sized = rows.select("id", "sha1").filter(F.octet_length("html") >= REVISIT_BYTES)
    copied = written(sized.groupBy("sha1").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    total = copied.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    if total:
        rows = joined_by_key(rows, copied, ["sha1"], "copies", max(total, 1), how="left")
    else:
        rows = rows.withColumn("last", F.lit(None).cast("long"))
    return rows.select("id", "url", "html", "sha1", F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page: str = "html", url: str = "url", ident: str = "page_id") -> DataFrame:
    """Writes a record per page into archives under ``folder`` and returns their manifest: path, records, bytes.

    A null page is an empty payload; a null id leaves the record's id empty, and such a record is a response only where
    no page with its payload has an id or the payload is small; rows that repeat the largest id are all responses;
    columns other than the three named are ignored.  The manifest is written before it is returned, and only the
    archives that it lists are whole.
    """

    def run(batches):
        writer = ArchiveWriter(folder)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for i, u, html, sha1, to in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    writer.add(record_bytes(i, u, html.encode("utf-8"), sha1, to))
        writer.close()
        cols = list(zip(*writer.manifest, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int64())], ["path", "records", "bytes"])

    return written(with_revisits(pages, page, url, ident).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives: id, url, record_type, refers_to, payload (null for a revisit),
    payload_bytes and payload_digest (hexadecimal SHA-1, both of the full payload; a response's are computed anew)."""

    def run(batches):
        fs, _ = open_fs(folder)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, size, n = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_records(stream):
                        out.append(_row(headers, block))
                        size, n = size + len(block), n + 1
                        if size > 4_000_000:
                            yield _batch(out)
                            out, size = [], 0
                if n != records:
                    raise ValueError(f"{path} has {n} of {records} records")
                if out:
                    yield _batch(out)

    archives = max(1, min(manifest.count(), 10_000))
    return manifest.select("path", "records").repartition(archives, "path").mapInArrow(run, "id long, url string, record_type string, refers_to long, payload string, payload_bytes long, payload_digest string")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    def page(name: str) -> int | None:
        value = headers.get(name, "")[len("<urn:page:") : -1]
        return int(value) if value else None

    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    sha1 = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
    if headers["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1:
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        body = payload.decode("utf-8")
    else:
        body = None
    return page("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers["WARC-Type"], page("WARC-Refers-To"), body, size, sha1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = ["id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives beside the checkpoints, as a URI."""
    path = new_path(pages.sparkSession, "warc")
    return path if "://" in path else "file://" + path if path.startswith("/") else path
