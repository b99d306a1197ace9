"""Byte formats: round trips over random rows, and damage."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.functions.records import DELETE, INSERT, Block, Corrupt, Table, WriteBatch
from tessera.sources import formats, paths
from tessera.sources.store import Options, Store


def entries(r, n, spread=60):
    """Random internal entries, sorted."""
    rows = {(f"key/{r.randrange(spread):04d}".encode() + r.choice([b"", b"\xff", "é".encode()]), s) for s in range(1, n + 1)}
    made = [(records.internal(k, s, kind := r.choice([DELETE, INSERT, INSERT])), r.randbytes(r.randrange(1, 40)) if kind else b"") for k, s in rows]
    return sorted(made, key=lambda e: records.order(e[0]))


def test_write_batch():
    a, b = WriteBatch(7), WriteBatch()
    a.put("k", "v" * 300)
    a.delete("é")
    b.put("empty", "")
    a.extend(b)
    back = WriteBatch.decode(a.encode())
    assert back == a and a.count() == 3 and a.size() == len(a.encode())
    assert list(back.rows()) == [(7, b"k", INSERT, b"v" * 300), (8, "é".encode(), DELETE, None), (9, b"empty", DELETE, None)]
    data = a.encode()
    for bad in (data[:5], data[:-1], data[:12] + b"\x07" + data[13:], data + b"\x00\x00"):
        with pytest.raises(Corrupt):
            WriteBatch.decode(bad)


@pytest.mark.parametrize("sizes", [[0, 1, 10], [32768 - 7], [32768 - 8, 5], [32768 - 14, 3], [100_000, 0, 70_000]])
def test_log_round_trip_and_damage(sizes):
    r = random.Random(sum(sizes))
    rows = [r.randbytes(n) for n in sizes]
    data = records.log_bytes(rows)
    assert list(records.log_records(data)) == rows
    for _ in range(20):
        at = r.randrange(len(data))
        torn, flipped = data[:at], data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
        for bad in (torn, flipped):
            got = list(records.log_records(bad))
            assert got == rows[: len(got)]


def test_edit_round_trip():
    edit = {"comparator": "bytewise", "log_number": 9, "prev_log": 0, "next_file": 300, "last_sequence": 2**40, "pointers": [(1, b"k" * 8)], "deleted": [(2, 7), (2, 8)], "added": [(3, 11, 4096, records.internal(b"a", 5, 1), records.internal("中".encode(), 1, 1))]}
    assert records.edit_fields(records.edit_bytes(edit)) == edit and records.edit_fields(b"") == {}
    with pytest.raises(Corrupt):
        records.edit_fields(bytes([9, 1]))
    with pytest.raises(Corrupt):
        records.edit_fields(records.edit_bytes(edit)[:-3])


@pytest.mark.parametrize("interval", [1, 3, 16])
def test_block_seek(interval):
    rows = entries(random.Random(interval), 100)
    block = Block(records.block_bytes(rows, interval))
    assert list(block.entries()) == rows
    for target in [*(k for k, _ in rows[::7]), records.internal(b"", 1, 1), records.internal(b"zzz", 1, 1), records.internal(b"key/0030", 50, 1)]:
        assert list(block.seek(target)) == [e for e in rows if records.order(e[0]) >= records.order(target)]
    assert list(Block(records.block_bytes([])).entries()) == []


@pytest.mark.parametrize("filters", [True, False])
def test_table_scan_and_get(filters):
    rows = entries(random.Random(6), 400)
    data = records.table_bytes(rows, 300, 4, filters)
    table = Table(data)
    assert len(table.index) > 5 and list(table.entries()) == rows and (table.filter is None) != filters
    for target in (rows[0][0], rows[57][0], records.internal(b"key/0031", 2**56 - 1, 1), records.internal(b"zzz", 1, 1)):
        assert list(table.entries(target)) == [e for e in rows if records.order(e[0]) >= records.order(target)]
    for key in {k[:-8] for k, _ in rows} | {b"absent", b"key/0000x"}:
        for snapshot in (2**56 - 1, 200, 1):
            seen = [(*records.unpacked(k)[1:], v) for k, v in rows if k[:-8] == key and records.unpacked(k)[1] <= snapshot]
            assert table.get(key, snapshot) == (max(seen) if seen else None)
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises(Corrupt):
        list(Table(bytes(broken)).entries())
    with pytest.raises(Corrupt):
        Table(data[:-1])
    assert list(Table(records.table_bytes([])).entries()) == []


def test_filters_miss_nothing():
    r = random.Random(8)
    blocks = [(at, [r.randbytes(r.randrange(1, 9)) for _ in range(20)]) for at in (0, 500, 2100, 9000)]
    data = records.filter_bytes(blocks)
    assert all(records.filter_matches(data, at, k) for at, keys in blocks for k in keys)
    assert sum(records.filter_matches(data, 0, r.randbytes(12)) for _ in range(500)) < 40
    assert not records.filter_matches(data, 4096, b"x") and records.filter_matches(data, 1 << 20, b"x")
    for size in range(7):
        key = bytes(range(size))
        assert records.bloom_matches(records.bloom([key]), key) and not records.bloom_matches(b"", key)


def test_internal_keys():
    key = records.internal(b"k", 2**56 - 1, INSERT)
    assert records.unpacked(key) == (b"k", 2**56 - 1, INSERT)
    assert records.order(records.internal(b"k", 2, 1)) < records.order(records.internal(b"k", 1, 1)) < records.order(records.internal(b"l", 9, 1))
    with pytest.raises(Corrupt):
        records.unpacked(records.internal(b"k", 1, 2))


def test_logs_of_a_folder(spark):
    store = Store.open(spark, paths.new_path(spark, "store"), Options(create_if_missing=True))
    store.write([("a", "1"), ("b", None)])
    store.write([("é", "2")])
    ops = formats.replay(formats.read_logs(spark, store.path)).orderBy("seq").collect()
    assert [(r["log_number"], r["base"], r["seq"], r["k"], r["vtype"], r["v"]) for r in ops] == [(1, 1, 1, "a", 1, "1"), (1, 1, 2, "b", 0, None), (1, 3, 3, "é", 1, "2")]


def test_empty_frames(spark):
    none = spark.createDataFrame([], "number long, k string, seq long, vtype int, v string")
    assert formats.scan_tables(formats.write_tables(none)).count() == 0
    assert formats.get_from_tables(formats.write_tables(none), "k").count() == 0
    logs = formats.write_logs(spark.createDataFrame([], "log_number long, base long, ops array<struct<k: string, vtype: int, v: string>>"))
    assert formats.replay(logs).select(F.max("seq")).first()[0] is None
