"""Queries over events whose ids have gaps and do not start at 0, over few of them and over large ids."""

from math import isqrt

import duckdb
import pytest

from tessera.functions.records import varint
from tessera.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("ids", [range(0, 4000, 40), [*range(500, 540), *range(9000, 9060)], range(0)])
def test_store_holds_all_events(spark, tmp_path, ids):
    rows = [(i, j % 60, "error" if j % 9 == 0 else "click", f"p{i}") for j, i in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLES["q49_store_compacted"]).fetchall()
    got = [(r["k"], r["seq"], r["v"]) for r in QUERIES["q49_store_compacted"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert bool(want) == bool(rows)


def events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("n", [0, 1])
def test_no_compaction_is_due_over_few_events(spark, tmp_path, n):
    path = events(spark, tmp_path, [(0, 7, "click", "p")][:n])
    out = QUERIES["q55_picked_compaction"](spark, path)
    assert out.columns == ["part", "number"] and out.collect() == []


def test_lengths_beyond_six_bytes(spark, tmp_path):
    seqs = [s + i for p in (0, 7, 35, 42, 49, 56) for s in [isqrt(2**p // 977) + 1] for i in (-1, 0) if s + i > 0]
    path = events(spark, tmp_path, [(s - 1, 7, "click", "p") for s in seqs])
    got = {r["x"]: r["n"] for r in QUERIES["q41_varint_length"](spark, path).collect()}
    assert got == {977 * s * s: len(varint(977 * s * s)) for s in seqs} and {5, 6, 7, 8, 9} <= set(got.values())
