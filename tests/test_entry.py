"""The registered queries: names, and results beside their SQL on the smallest tables."""

import importlib
import math
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from corvane.plans import queries as search

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)):
        return round(float(x), 6)
    return str(x)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(search.SQL) <= set(search.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(search.QUERIES) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(search.SQL))
def test_query_beside_its_sql(spark, duck, name):
    got, want = search.QUERIES[name](spark, str(SMALL)).toPandas(), duck.execute(search.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@needs_data
def test_the_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_a_missing_part_is_left_out_and_a_broken_one_is_not(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=name.rpartition(".")[0] or name)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(entry.queries()) == set(search.QUERIES)

    def broken(name):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
