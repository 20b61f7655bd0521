"""Every registered query against its DuckDB SQL on sf0.001, by columns and values."""

import re

import duckdb
import pandas as pd
import pytest

from inkquarry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    cell = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for c in ours.columns:
        if str(ours[c].dtype).startswith("datetime"):
            ours[c], theirs[c] = ours[c].astype("datetime64[us]").astype(str), theirs[c].astype("datetime64[us]").astype(str)
    assert rows(ours) == rows(theirs)


def test_queries_without_sql():
    """These are held against brute force in tests/test_engine.py; any other query has SQL."""
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"greedy_dedupe", "greedy_match", "scored_context", "kmeans_clusters", "colour_series", "synth_rows"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


