"""Every registered query of the conversation engine against its DuckDB counterpart."""

import os
from collections import Counter

import duckdb
import pytest

from recollect import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("conversations", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(r) for r in got.fetchall())
    have = Counter(tuple(r[c] for c in columns) for r in rows)
    assert have == want, (list((have - want).items())[:2], list((want - have).items())[:2])
