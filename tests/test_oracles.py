"""Every query of the core with SQL gives what DuckDB gives on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from conftest import SMALL
from lodestone.plans import catalogue, evidence  # noqa: F401


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.10g}" if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return [columns[i] for i in order], Counter(tuple(repr(show(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    cur = duck.execute(catalogue.ORACLES[name])
    want = canonical(cur.fetchall(), [c[0] for c in cur.description])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_run(spark, name):
    # none of the few questions of the smallest tables that are asked is a comparison
    folder = SMALL.replace("sf0.001", "sf0.01") if name == "compared_passages" else SMALL
    assert catalogue.QUERIES[name](spark, folder).count() > 0
