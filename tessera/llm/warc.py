"""WARC archives through a chunked record table.

Writing cuts the pages into a saved table once: a head row per page (identity, digest, size) and rows (page,
chunk number, compressed bytes) of at most ``chunk_bytes``, made one after the other. A page's chunks are left out where its
task has seen the same payload under a smaller id, as it is then no response. Heads alone decide which record
of equal payloads (by SHA-256) is the response; then heads and chunks meet in one shuffle, and chunks
stream into the archives. Reading gives the chunk rows back, each with the digest and length of the payload
up to and including itself, so no reader or writer holds a whole record.

Archives are gzip members, one per record, in files of about ``ARCHIVE`` payload bytes in the shared folder; a task
writes under a name of its own and renames it at the end, so a task that runs again, or twice, leaves one whole
file. The reader takes any records of WARC 1.0 and 1.1, compressed or not, and of other writers.

Rows: a null payload counts as empty; of records with equal payloads and the smallest id all are
responses (rows that repeat); a null id is larger than any other; a null URL is written empty; extra
columns may have any name and are not written; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .memory import released
from .store import discard, new_path, saved

CHUNK = 1 << 20
#: Payload bytes of an archive, about; keys of equal payloads are dealt to so many groups.
ARCHIVE, SALTS = 128 << 20, 256
#: Fixed values of the format.
VERSION, VERSIONS, PROFILE = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "path string, record_no long, record_id string, chunk_no long, id string, uri string, record_type string, refers_to string, payload_digest string, declared_bytes long, bytes_so_far long, digest_so_far string"


def _open(uri: str, mode: str):
    """A file by path or URI: local ones directly, others through Arrow's file systems."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        path = unquote(parsed.path)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if mode == "wb" else system.open_input_stream(path)


def _move(source: str, target: str) -> None:
    if urlparse(source).scheme in ("", "file"):
        os.replace(unquote(urlparse(source).path), unquote(urlparse(target).path))
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(source)
    system.move(path, fs.FileSystem.from_uri(target)[1])


def _sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _cutter(chunk_bytes: int, least_revisit: int, kind: pa.DataType):
    """(id, uri, payload) -> head rows (chunk number -1) and chunk rows. A payload's chunks come with every page
    that may be the first with that payload: none before it in this task has a smaller id."""
    names = ["row", "chunk_no", "id", "uri", "key", "digest", "size", "data"]
    kinds = [pa.int64(), pa.int64(), kind, pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, best, out, held = TaskContext.get().partitionId() << 36, {}, [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        for batch in batches:
            for page, uri, payload in zip(*(batch.column(c) for c in ("id", "uri", "payload")), strict=True):
                data = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                sha, key = hashlib.sha1(usedforsecurity=False), hashlib.sha256()
                for k in range(0, len(data), CHUNK):
                    sha.update(data[k : k + CHUNK])
                    key.update(data[k : k + CHUNK])
                place = (not page.is_valid, page.as_py() if page.is_valid else 0)
                out.append((row, -1, page.as_py(), uri.as_py(), key.digest(), _sha1(sha.digest()), len(data), None))
                if len(data) < least_revisit or place <= best.get(key.digest(), place):
                    best[key.digest()] = place
                    for no, k in enumerate(range(0, len(data), chunk_bytes)):
                        part = zlib.compress(data[k : k + chunk_bytes], 1)
                        out.append((row, no, None, None, None, None, None, part))
                        held += len(part)
                        if held >= 4 << 20:
                            yield flush()
                            out, held = [], 0
                row += 1
                if len(out) >= 1000:
                    yield flush()
                    out, held = [], 0
        yield flush()

    return run


def plan_records(heads: DataFrame, least_revisit: int = 0) -> DataFrame:
    """``heads(row, id, key, size, ...)`` with ``record_type`` and, of a revisit, ``refers`` and ``refers_row``: the smallest id with
    the same payload; payloads under ``least_revisit`` bytes are all responses. Of a key, however frequent,
    at most ``SALTS`` rows meet in a task, and each of these meets its share of the heads."""
    dealt = heads.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    some = dealt.groupBy("key", "salt").agg(F.min(place).alias("first"))
    first = some.groupBy("key").agg(F.min("first").alias("first"))
    known = some.select("key", "salt").join(first, "key")
    out = dealt.join(known, ["key", "salt"])
    whole = (F.col("size") < least_revisit) | F.col("id").eqNullSafe(F.col("first.id"))
    return out.withColumns({"refers": F.when(~whole, F.col("first.id").cast("string")), "refers_row": F.when(~whole, F.col("first.row")), "record_type": F.when(whole, "response").otherwise("revisit")}).drop("salt", "first", "key")


def _header(pairs: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs) + b"\r\n"


def _clean(text: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", text or "")


def _urn(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row))}>"


def _writer(folder: str, level: int):
    """Rows sorted by (row, chunk number), a head before its chunks -> one archive; yields its path and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, temp = f"{folder}/part-{part:06d}.warc.gz", f"{folder}/part-{part:06d}.{uuid.uuid4().hex}.tmp"
        out, gz, n, size, left = None, None, 0, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = _open(temp, "wb")
                if r["chunk_no"] < 0:
                    n += 1
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n".encode()
                    full = r["record_type"] == "response"
                    left = r["size"] if full else 0
                    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", _urn(r["row"])), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(r["uri"])), ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("Page-ID", _clean(r["id"])), ("Payload-Length", str(r["size"]))]
                    if not full:
                        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(r["refers_row"])), ("Refers-To-Page", _clean(r["refers"]))]
                    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + left))]
                    out.write(gz.compress(_header(head) + http))
                elif left:  # chunks of a page that turned out to be a revisit go no further
                    data = zlib.decompress(r["data"])
                    out.write(gz.compress(data))
                    size += len(data)
                    left -= len(data)
                if not left and gz is not None:
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    gz = None
        if out is not None:
            out.close()
            _move(temp, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "payload_bytes": pa.array([size], pa.int64())})

    return run


def write_archives(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", least_revisit: int = 0, chunk_bytes: int = CHUNK, level: int = 1) -> DataFrame:
    """Writes the archives; returns their table ``(path, records, payload_bytes)``."""
    spark = df.sparkSession
    pages = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("string").cast("binary").alias("payload"))
    kind = pages.schema["id"].dataType
    table = f"row long, chunk_no long, id {kind.simpleString()}, uri string, key binary, digest string, size long, data binary"
    cut = saved(pages.mapInArrow(released(_cutter(chunk_bytes, least_revisit, to_arrow_type(kind))), table), "pages")
    heads = cut.where("chunk_no < 0").select("row", "chunk_no", "id", "uri", "key", "digest", "size")
    total = heads.agg(F.sum("size")).first()[0] or 0
    archives = max(spark.sparkContext.defaultParallelism, -(-total // ARCHIVE))
    planned = plan_records(heads, least_revisit).withColumn("id", F.col("id").cast("string"))
    rows = planned.unionByName(cut.where("chunk_no >= 0").select("row", "chunk_no", "data"), allowMissingColumns=True)
    write = released(_writer(new_path(spark, "warc"), level))
    out = saved(rows.repartition(archives, "row").sortWithinPartitions("row", "chunk_no").mapInArrow(write, "path string, records long, payload_bytes long"), "archives")
    discard(cut)
    return out


class _Reader:
    """Bytes of a file, of gzip members or plain, as they are asked for."""

    def __init__(self, path: str):
        self.file, self.buffer = _open(path, "rb"), bytearray()
        self.spare = self.file.read(1 << 16)
        self.gz = zlib.decompressobj(31) if self.spare[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        while True:
            data, self.spare = self.spare or self.file.read(1 << 16), b""
            if not data:
                return False
            if self.gz is None:
                self.buffer += data
                return True
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            plain = self.gz.decompress(data, 1 << 20)
            self.spare = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if plain:
                self.buffer += plain
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to the mark, which is taken too; None at the end of the file."""
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a header")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while len(self.buffer) < most and self.more():
            pass
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out


def records(path: str, chunk_bytes: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive, in order. The payload of an HTTP message is what follows its header, that of any
    other record its whole block; what a record does not declare is null."""
    r, number = _Reader(path), 0
    try:
        while (head := r.until(b"\r\n\r\n")) is not None:
            lines = head.lstrip(b"\r\n").split(b"\r\n")
            if lines[0] not in VERSIONS:
                raise ValueError(f"{path}: not a WARC record")
            h = {k.decode().strip().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
            left = int(h["content-length"])
            if left and h.get("content-type", "").startswith("application/http") and h.get("warc-type") in ("response", "revisit"):
                http = r.until(b"\r\n\r\n")
                left -= len(http or b"") + 4
            if left < 0:
                raise ValueError(f"{path}: a record ends inside its HTTP header")
            digest, size = h.get("warc-payload-digest"), h.get("payload-length")
            row = {"path": path, "record_no": number, "record_id": h.get("warc-record-id"), "id": h.get("page-id") or None, "uri": h.get("warc-target-uri"), "record_type": h.get("warc-type")}
            row |= {"refers_to": h.get("refers-to-page") or h.get("warc-refers-to"), "payload_digest": digest and digest.removeprefix("sha1:"), "declared_bytes": int(size) if size else None}
            number += 1
            sha, so_far, no = hashlib.sha1(usedforsecurity=False), 0, 0
            while True:
                data = r.take(min(left, chunk_bytes))
                if left and not data:
                    raise ValueError(f"{path}: archive ends inside a record")
                left -= len(data)
                so_far += len(data)
                sha.update(data)
                yield row | {"chunk_no": no, "bytes_so_far": so_far, "digest_so_far": _sha1(sha.copy().digest()), "data": data}
                no += 1
                if not left:
                    break
            if r.take(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: record isn't closed")
    finally:
        r.file.close()


def _reading(chunk_bytes: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"] * with_data
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in CHUNKS.split(", ")] + [pa.binary()] * with_data
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in records(path, chunk_bytes):
                    held.append(row)
                    size += len(row["data"]) if with_data else 0
                    if len(held) >= 1000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return run


def read_chunks(archives: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of ``archives(path)``; a record without bytes has one empty chunk. An archive is a
    task's unit, and there are as many tasks as archives."""
    paths = archives.select("path")
    dealt = paths.repartitionByRange(max(1, paths.count()), "path")
    return dealt.mapInArrow(released(_reading(chunk_bytes, with_data)), CHUNKS + (", data binary" if with_data else ""))


def read_records(archives: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per record, without its bytes. For a response, length and digest are those of the
    bytes read; one that differs from its header is an error."""
    fields = ("record_id", "id", "uri", "record_type", "refers_to", "payload_digest", "declared_bytes", "bytes_so_far", "digest_so_far")
    per = read_chunks(archives, chunk_bytes, False).groupBy("path", "record_no").agg(F.max_by(F.struct(*fields), "chunk_no").alias("r"))
    bad = "r.record_type = 'response' and (r.digest_so_far <> r.payload_digest or r.bytes_so_far <> r.declared_bytes)"
    size, digest = (F.expr(f"if({bad}, raise_error(concat('payload differs from its header: ', r.record_id)), if(r.record_type = 'revisit', coalesce(r.{b}, r.{a}), r.{a}))") for a, b in (("bytes_so_far", "declared_bytes"), ("digest_so_far", "payload_digest")))
    return per.select("r.record_id", "r.id", "r.uri", size.cast("long").alias("payload_bytes"), digest.cast("string").alias("payload_digest"), "r.record_type", "r.refers_to")
