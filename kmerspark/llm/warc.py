"""WARC files as a chunked record table.

``read_chunks`` streams WARC files (plain, or gzip with a member a record) into rows of
(record, chunk number): a payload is never held whole, only one chunk of at most
``CHUNK_BYTES`` and the state of its digest. Each row carries the digest of the payload up
to and including its chunk; the last row of a record also tells whether the payload was
complete and agrees with the digest in the record's header. ``write_warc`` writes pages as
such files, one a partition.

For a response record the payload is the body after the HTTP header, for any other record
its whole block. A record without payload has one row, of an empty chunk. A record that the
file cuts short, or whose compressed data are damaged, ends with ``complete`` false. Reading
goes on at the next gzip member, or in a plain file at the next line that begins a record;
what had to be skipped (damaged data, an unreadable header, or one of over ``HEADER_BYTES``)
is a row of type ``unreadable`` in its place. Zero bytes between gzip members are padding.

Defined results: null HTML is written as an empty payload, a null URL as an empty one (null
again when read), a null identifier is null when read. Repeated rows become records of their
own, so ties do not matter. An empty table gives no record. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.session import checkpointed, shared_dir

CHUNK_BYTES = 32 << 10
_READ = 256 << 10
_FLUSH = 4 << 20
HEADER_BYTES = 1 << 20
#: Where a header ends, with the line ends that are met.
_BLANK = re.compile(rb"\r?\n\r?\n")
_MEMBER = b"\x1f\x8b\x08"
UNREADABLE = "unreadable"
SCHEMA = "record_id string, page_id bigint, url string, record_type string, chunk int, start bigint, length int, payload binary, digest string, last boolean, complete boolean, digest_ok boolean"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]


class Stream:
    """Bytes of a WARC file, decompressed as they are asked for.

    Where compressed data are damaged the stream ends; ``resume`` goes on behind that.
    """

    def __init__(self, source):
        self.source, self.buffer, self.at, self.done, self.broken = source, b"", 0, False, False
        head = source.read(2)
        self.packed = head == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None
        self.raw = head

    def _more(self) -> bool:
        """Add decompressed bytes to the buffer; false at the end of the file or of what can be read."""
        while not self.done and not self.broken:
            raw = self.raw or self.source.read(_READ)
            self.raw = b""
            if not raw:
                self.done = True
                return False
            if not self.packed:
                fresh = raw
            else:
                if self.inflate.eof:
                    raw = raw.lstrip(b"\0")
                    if not raw:
                        continue
                    self.inflate = zlib.decompressobj(31)
                try:
                    fresh = self.inflate.decompress(raw, _READ)
                    self.raw = self.inflate.unused_data or self.inflate.unconsumed_tail
                except zlib.error:
                    self.broken, self.raw = True, raw[1:]
                    return False
            if fresh:
                self.buffer, self.at = self.buffer[self.at :] + fresh, 0
                return True
        return False

    def _next_member(self) -> bool:
        """Go to the raw bytes that begin a gzip member; whether there are any."""
        while True:
            found = self.raw.find(_MEMBER)
            if found >= 0:
                self.raw, self.inflate, self.broken = self.raw[found:], zlib.decompressobj(31), False
                return True
            fresh = self.source.read(_READ)
            if not fresh:
                self.done, self.raw = True, b""
                return False
            self.raw = self.raw[-2:] + fresh

    def resume(self) -> bool:
        """Skip to where the next record may begin; false at the end of the file."""
        if self.packed and self.broken:
            self.buffer, self.at = b"", 0
            return self._next_member()
        while True:
            # a record begins a line; one byte on, so as not to meet the same place again
            found = self.buffer.find(b"\nWARC/", self.at)
            if found >= 0:
                self.at = found + 1
                return True
            self.at = max(self.at, len(self.buffer) - 5)
            if not self._more():
                return self.broken and self.resume()

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, none only at the end."""
        if self.at >= len(self.buffer) and not self._more():
            return b""
        out = self.buffer[self.at : self.at + most]
        self.at += len(out)
        return out

    def header(self, most: int = HEADER_BYTES) -> bytes | None:
        """The bytes before a blank line, which is skipped; None if it does not come."""
        looked = self.at
        while True:
            found = _BLANK.search(self.buffer, max(self.at, looked))
            if found and found.start() - self.at <= most:
                out, self.at = self.buffer[self.at : found.start()], found.end()
                return out
            if len(self.buffer) - self.at > most:
                return None
            rest = len(self.buffer) - self.at
            if not self._more():
                return None
            looked = max(0, rest - 3)


def header_fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        name, mark, value = line.partition(":")
        if mark:
            fields[name.strip().lower()] = value.strip()
    return fields


def records(stream: Stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for every record of a stream."""
    unreadable = (None, None, None, UNREADABLE, 0, 0, 0, b"", hashlib.sha1().hexdigest(), True, False, None)
    while True:
        byte = stream.take(1)
        while byte in (b"\r", b"\n"):
            byte = stream.take(1)
        if not byte:
            if not stream.broken:
                return
            yield unreadable
            if not stream.resume():
                return
            continue
        head = stream.header()
        if head is None or not (byte + head).startswith(b"WARC/") or not header_fields(byte + head).get("content-length", "").isdigit():
            yield unreadable
            if not stream.resume():
                return
            continue
        fields = header_fields(byte + head)
        left = int(fields["content-length"])
        kind = fields.get("warc-type")
        page = fields.get("warc-page-id", "")
        base = (fields.get("warc-record-id"), int(page) if page.lstrip("-").isdigit() else None, fields.get("warc-target-uri") or None, kind)
        pending = b""
        if kind == "response" and fields.get("content-type", "").startswith("application/http"):
            # the HTTP header ends at a blank line; its bytes are not payload
            while left and not _BLANK.search(pending) and len(pending) < HEADER_BYTES:
                piece = stream.take(min(left, _READ))
                if not piece:
                    break
                pending += piece
                left -= len(piece)
            blank = _BLANK.search(pending)
            # without a blank line there is no header to leave out
            pending = pending[blank.end() :] if blank else pending
        digest, number, start, cut = hashlib.sha1(), 0, 0, False
        while True:
            while len(pending) < chunk_bytes and left and not cut:
                piece = stream.take(min(left, chunk_bytes - len(pending)))
                cut = not piece
                pending += piece
                left -= len(piece)
            chunk, pending = pending[:chunk_bytes], pending[chunk_bytes:]
            digest.update(chunk)
            last = not pending and (not left or cut)
            stated = fields.get("warc-payload-digest") or (fields.get("warc-block-digest") if kind != "response" else None)
            good = None
            if last and stated:
                own = digest.digest()
                good = stated.partition(":")[2].upper() in (base64.b32encode(own).decode(), own.hex().upper())
            yield (*base, number, start, len(chunk), chunk, digest.hexdigest(), last, not left if last else None, good)
            number, start = number + 1, start + len(chunk)
            if last:
                break


def encode_record(page_id: int | None, url: str | None, html: str | None, serial: str) -> Iterator[bytes]:
    """A response record, in pieces."""
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{serial}|{page_id}|{url}")
    lines = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", "WARC-Date: 2026-01-01T00:00:00Z"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", f"Content-Length: {len(http) + len(body)}"]
    lines += [f"WARC-Page-Id: {page_id}"] if page_id is not None else []
    yield "\r\n".join(lines).encode() + b"\r\n\r\n" + http
    yield body
    yield b"\r\n\r\n"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as gzip WARC files; (path, records, n_bytes) of each file.

    A file's name holds a fresh number, so a task that runs again never touches a file that
    another attempt wrote; only the files listed in the result count. The result is written
    down, as listing it again would write again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = out = None
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        number = size = 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                if out is None:
                    system, base = _open(folder)
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base.rstrip('/')}/{path.rpartition('/')[2]}", compression=None)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in encode_record(page_id.as_py(), url.as_py(), html.as_py(), f"{path}#{number}"):
                    data = squeeze.compress(piece)
                    size += len(data)
                    out.write(data)
                data = squeeze.flush()
                size += len(data)
                out.write(data)
                number += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "n_bytes"])

    listed = pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "path string, records bigint, n_bytes bigint")
    return checkpointed(listed)


def read_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table (``SCHEMA``) of the WARC files that column ``path`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = _open(uri)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for row in records(Stream(source), chunk_bytes):
                        rows.append(row)
                        held += row[6] + 200
                        if held >= _FLUSH:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    # a task a file: the files are the unit of reading
    count = max(1, files.count())
    return files.select("path").repartition(count, "path").mapInArrow(run, SCHEMA)


def pages_to_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pages through WARC files in the shared folder into the chunk table."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_chunks(write_warc(pages, folder), chunk_bytes)


ORACLE = f"""
WITH bodies AS (SELECT page_id, url, encode(html) AS body FROM pages),
cut AS (SELECT page_id, url, body, octet_length(body) AS size, unnest(range(0, greatest((octet_length(body) + {CHUNK_BYTES - 1}) // {CHUNK_BYTES}, 1))) AS chunk FROM bodies)
SELECT page_id, url, 'response' AS record_type, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * {CHUNK_BYTES} AS BIGINT) AS start, CAST(least(size - chunk * {CHUNK_BYTES}, {CHUNK_BYTES}) AS INTEGER) AS length,
 base64(body[chunk * {CHUNK_BYTES} + 1:least((chunk + 1) * {CHUNK_BYTES}, size)]) AS payload, sha1(body[1:least((chunk + 1) * {CHUNK_BYTES}, size)]) AS digest,
 (chunk + 1) * {CHUNK_BYTES} >= size AS last, CASE WHEN (chunk + 1) * {CHUNK_BYTES} >= size THEN true END AS complete, CASE WHEN (chunk + 1) * {CHUNK_BYTES} >= size THEN true END AS digest_ok
FROM cut
"""
