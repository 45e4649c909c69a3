"""The training-data queries that SQL can express, against their DuckDB counterparts."""

import os
from collections import Counter

import duckdb
import pytest

from recollect.llm.queries import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")

LONG = " ".join(f"word{i}" for i in range(400))
ODD = [None, "", " \t\n", "one", "ONE", "one two", "one  two\n", "É é", "é é", "a" * 49, "a" * 50, "a" * 120, "ab" * 60, LONG, LONG.upper(), LONG.replace("word7", "other7"),
       "x" + LONG, LONG[:-1], LONG[1000:1400] + "ü" * 60, "ü" * 60, "ö" + "ü" * 40, "\x00" * 70, "q\x00" * 40, LONG[500:700] * 3]


def agrees(spark, folder, name):
    con = duckdb.connect()
    files = f"{folder}/documents.parquet" + "/*.parquet" * os.path.isdir(f"{folder}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
    got = con.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    want = Counter(got.fetchall())
    df = QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(df.columns)
    have = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert have == want, (list((have - want).items())[:2], list((want - have).items())[:2])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_whole_table(spark, name):
    agrees(spark, SF, name)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_texts(spark, name, tmp_path):
    rows = [(3 * i + 1, t, "en", "s", 0) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    agrees(spark, str(tmp_path), name)
