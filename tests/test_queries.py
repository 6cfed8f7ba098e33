"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from gleaner.plans import companies, display, evidence, feeds, markup, notices, pages, records, runs, searches, statements, statistics, stores, versions, web

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for m in (records, web, stores, feeds, runs, notices, statements, statistics, companies, display, markup, searches, evidence, pages, versions) for k, v in m.ORACLES.items()}
QUERIES = {k: v for m in (records, web, stores, feeds, runs, notices, statements, statistics, companies, display, markup, searches, evidence, pages, versions) for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    said = db.execute(ORACLES[name])
    assert canonical(map(tuple, got.collect()), got.columns) == canonical(said.fetchall(), [d[0] for d in said.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
