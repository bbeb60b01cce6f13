"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from ledgerloom.plans import graphs, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_graphs_ladders_and_precedence_read_whole_tables(spark, duck, sf):
    edges, documents = graphs.effect_edges(spark, sf)
    assert (edges.count(), documents.count()) == duck.execute("SELECT (SELECT count(*) FROM lineitem), (SELECT count(*) FROM part)").fetchone()
    parts, users = duck.execute("SELECT (SELECT count(*) FROM part), (SELECT count(DISTINCT user_id) FROM events)").fetchone()
    assert registry.QUERIES["compliance_ladder"](spark, sf).count() == registry.QUERIES["effective_sources"](spark, sf).count() == parts
    assert registry.QUERIES["temporal_precedence"](spark, sf).count() == users


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
