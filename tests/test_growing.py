"""Queries over pairs that grow with the data, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from lexisim.plans import growing, oracle

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.growing_sql(growing.ODD)


@pytest.mark.parametrize("name", sorted(growing.QUERIES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = growing.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert len(rows) > 10 and sorted(map(repr, rows)) == sorted(map(repr, want))


def test_pairs_grow_without_a_self_join(spark):
    plan = growing.neighbours(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
