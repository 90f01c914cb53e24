"""Every query with an oracle gives its rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lamina.plans import catalogue

SF = "/root/testdata/sf0.001"
SAMPLE = sorted(catalogue.ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "null" if v is None or v != v else round(float(v), 5) if isinstance(v, (float, np.floating)) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr), list(frame.columns)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seeds_cover(spark):
    got = catalogue.QUERIES["r04_weighted_magnifications"](spark, SF).collect()
    assert sum(r.n for r in got) == 4000 and {r.magnification for r in got} == {5, 10, 20, 40}


def test_sweep_is_whole(spark, monkeypatch):
    """The sweep runs over all strengths with the operator's own iterations."""
    from lamina.operators import regression

    asked = []
    monkeypatch.setattr(regression, "sweep", lambda rows, strengths, *a, **b: asked.append((len(strengths), a, b)))
    catalogue.QUERIES["m06_regression_sweep"](spark, SF)
    assert asked == [(45, (), {})]
