"""Each query of the driver tables against its SQL, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from trailweave import queries

#: A minute or more on a few rows; the driver runs them.
SLOW = {"worlds_study", "topo_signature"}


def plain(rows):
    return sorted(repr([round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r]) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - SLOW))
def test_query(spark, sf_dir, con, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    sql = queries.oracle_sql().get(name)
    if sql:
        assert plain(got) == plain(con.execute(f"select {', '.join(columns)} from ({sql})").fetchall())
    else:
        assert got


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["qid", "object_id", "content", "score", "hops", "explain"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
