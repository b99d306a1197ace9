"""The byte formats of :mod:`tessera.functions.records` over DataFrames: logs, tables and edits as rows of bytes.

A log or a table is bounded by its writer (a write buffer, a file size), so each is one row and one task's unit;
different ones are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions.records import DELETE, INSERT, Table, WriteBatch

OPS = "seq long, k string, vtype int, v string"


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of a partition that is sorted by ``key``, one group after the other."""
    return groupby((row for batch in batches for row in batch.to_pylist()), key=lambda r: r[key])


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def write_logs(batches: DataFrame) -> DataFrame:
    """``(log_number, base, ops array<struct<k, vtype, v>>)`` -> ``(log_number, data, records)``: the bytes of one log per
    number, a record per batch in the order of their sequences."""
    schema = pa.schema([("log_number", pa.int64()), ("data", pa.binary()), ("records", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _grouped(parts, "log_number"):
            payloads = [WriteBatch(r["base"], [(o["k"].encode(), o["v"].encode() if o["vtype"] == INSERT else None) for o in r["ops"]]).encode() for r in group]
            yield _emit([{"log_number": number, "data": records.log_bytes(payloads), "records": len(payloads)}], schema)

    dealt = batches.select(F.col("log_number").cast("long"), "base", "ops").repartition("log_number").sortWithinPartitions("log_number", "base")
    return dealt.mapInArrow(run, "log_number long, data binary, records long")


def replay(logs: DataFrame) -> DataFrame:
    """``logs(log_number, data)`` -> their operations ``(log_number, base, seq, k, vtype, v)``, as far as each log is whole."""
    schema = pa.schema([("log_number", pa.int64()), ("base", pa.int64()), ("seq", pa.int64()), ("k", pa.string()), ("vtype", pa.int32()), ("v", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, data in zip(part.column("log_number").to_pylist(), part.column("data").to_pylist(), strict=True):
                for payload in records.log_records(data):
                    batch = WriteBatch.decode(payload)
                    yield _emit([{"log_number": number, "base": batch.sequence, "seq": s, "k": k.decode(), "vtype": t, "v": None if v is None else v.decode()} for s, k, t, v in batch.rows()], schema)

    return logs.select(F.col("log_number").cast("long"), "data").mapInArrow(run, f"log_number long, base long, {OPS}")


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log files ``NNNNNN.log`` of a folder as ``(log_number, data)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    return files.select(F.regexp_extract("path", "([0-9]+)[.]log$", 1).cast("long").alias("log_number"), F.col("content").alias("data"))


def write_tables(rows: DataFrame, block_size: int = 4096) -> DataFrame:
    """``(number, k, seq, vtype, v)`` -> ``(number, data, smallest, largest, entries)``: one table file per number, in
    internal order. Of equal keys and sequences the first kind counts."""
    schema = pa.schema([("number", pa.int64()), ("data", pa.binary()), ("smallest", pa.string()), ("largest", pa.string()), ("entries", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _grouped(parts, "number"):
            own = list(group)
            entries = [(records.internal(r["k"].encode(), r["seq"], r["vtype"]), (r["v"] or "").encode()) for r in own]
            yield _emit([{"number": number, "data": records.table_bytes(entries, block_size), "smallest": own[0]["k"], "largest": own[-1]["k"], "entries": len(own)}], schema)

    dealt = rows.select(F.col("number").cast("long"), "k", "seq", "vtype", "v").repartition("number").sortWithinPartitions("number", "k", F.desc("seq"))
    return dealt.mapInArrow(run, "number long, data binary, smallest string, largest string, entries long")


def _row(number: int, key: bytes, value: bytes) -> dict:
    k, seq, kind = records.unpacked(key)
    return {"number": number, "k": k.decode(), "seq": seq, "vtype": kind, "v": value.decode() if kind == INSERT else None}


ROWS = pa.schema([("number", pa.int64()), ("k", pa.string()), ("seq", pa.int64()), ("vtype", pa.int32()), ("v", pa.string())])


def scan_tables(tables: DataFrame, low: str | None = None) -> DataFrame:
    """Entries of ``tables(number, data)``, all or those at or after a key: each table's index, then its blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = None if low is None else records.internal(low.encode(), 2**56 - 1, INSERT)
        for part in parts:
            for number, data in zip(part.column("number").to_pylist(), part.column("data").to_pylist(), strict=True):
                yield _emit([_row(number, k, v) for k, v in Table(data).entries(start)], ROWS)

    return tables.select("number", "data").mapInArrow(run, "number long, k string, seq long, vtype int, v string")


def get_from_tables(tables: DataFrame, key: str, snapshot: int = 2**56 - 1) -> DataFrame:
    """The newest visible version of a key in each of ``tables(number, data)``, a deletion too: index, filter, block."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for number, data in zip(part.column("number").to_pylist(), part.column("data").to_pylist(), strict=True):
                found = Table(data).get(key.encode(), snapshot)
                if found is not None:
                    seq, kind, value = found
                    out.append({"number": number, "k": key, "seq": seq, "vtype": kind, "v": value.decode() if kind == INSERT else None})
            yield _emit(out, ROWS)

    return tables.select("number", "data").mapInArrow(run, "number long, k string, seq long, vtype int, v string")


def write_edits(edits: DataFrame, files: DataFrame) -> DataFrame:
    """``edits(edit_id, is_add, level, number)`` and their files -> ``(edit_id, data)``: each edit's bytes."""
    schema = pa.schema([("edit_id", pa.int64()), ("data", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edit_id, group in _grouped(parts, "edit_id"):
            own = list(group)
            added = [(r["level"], r["number"], r["size"], *(records.internal(r[a].encode(), r[b], INSERT) for a, b in (("smallest", "max_seq"), ("largest", "min_seq")))) for r in own if r["is_add"]]
            edit = {"deleted": [(r["level"], r["number"]) for r in own if not r["is_add"]], "added": added}
            yield _emit([{"edit_id": edit_id, "data": records.edit_bytes({"comparator": records.COMPARATOR} | edit)}], schema)

    known = files.select("level", "number", "size", "smallest", "largest", "min_seq", "max_seq")
    rows = edits.join(known, ["level", "number"]).select(F.col("edit_id").cast("long"), F.col("is_add").cast("int"), F.col("level").cast("int"), F.col("number").cast("long"), F.col("size").cast("long"), "smallest", "largest", "min_seq", "max_seq")
    return rows.repartition("edit_id").sortWithinPartitions("edit_id", "level", "number").mapInArrow(run, "edit_id long, data binary")


def read_edits(edits: DataFrame) -> DataFrame:
    """``(edit_id, data)`` -> ``(edit_id, is_add, level, number, size, smallest, largest)``; deletions have no more than a number."""
    schema = pa.schema([("edit_id", pa.int64()), ("is_add", pa.int32()), ("level", pa.int32()), ("number", pa.int64()), ("size", pa.int64()), ("smallest", pa.string()), ("largest", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for edit_id, data in zip(part.column("edit_id").to_pylist(), part.column("data").to_pylist(), strict=True):
                found = records.edit_fields(data)
                out = [{"edit_id": edit_id, "is_add": DELETE, "level": a, "number": n} for a, n in found.get("deleted", [])]
                out += [{"edit_id": edit_id, "is_add": INSERT, "level": a, "number": n, "size": z, "smallest": s[:-8].decode(), "largest": e[:-8].decode()} for a, n, z, s, e in found.get("added", [])]
                yield _emit(out, schema)

    return edits.mapInArrow(run, "edit_id long, is_add int, level int, number long, size long, smallest string, largest string")
