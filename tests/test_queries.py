"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lumaquery.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if pd.isna(v):
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in ("f", "i", "u"):
            return f"{round(float(v), 6):.6f}"
        return str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
