"""Registered queries against their DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from leafwork.plans import page_queries, registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: The slow ones run as a whole in test_paragraphs.
SLOW = {"page_assembly", "titled_markdown", "image_injection"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == set(page_queries.EXTRA)


@pytest.mark.parametrize("name", sorted(page_queries.EXTRA))
def test_extra(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    if "level" in columns:  # a nullable integer is a float in pandas
        got, want = got.astype({"level": float}), want.astype({"level": float})
    assert rows(got, columns) == rows(want, columns)
