"""Queries with SQL against DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES


def rows(frame):
    cells = lambda v: None if pd.isna(v) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) and float(v) == int(v) else v
    return sorted(str(tuple(cells(v) for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("odd", [False, True])
def test_same_as_duckdb(spark, tmp_path, name, odd):
    """On a given table, and on rows that it does not hold."""
    sf_dir = "/root/testdata/sf0.01"
    if odd:
        sf_dir = str(tmp_path)
        texts = [None, "", " \n", "a@b.co 10.0.0.1 256.1.1.1 001.2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "call +49 (30) 1234.567-8", "é😀 iban PL61 1090 1014 0000 0712 1981 2874 BANK DE89 3704 0044 0532 0130 00"]
        texts += ["IBAN GB82WEST12345698765432 XGB82WEST12345698765432 GB82WEST123456987654321", "x" * 3000 + " 中文字 " * 50, "x" * 3000]
        docs = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts * 3)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts * 2)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{sf_dir}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet{'/*.parquet' if odd else ''}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)
