"""Every query against its SQL on the small input; queries without SQL against properties."""

import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def _value(x):
    if isinstance(x, float):
        return "NaN" if x != x else repr(x)
    if isinstance(x, (list, tuple)):
        return str([_value(y) for y in x])
    return str(x) if isinstance(x, (int, decimal.Decimal, str, type(None))) else type(x).__name__[:4] + str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, found.fetchall())


def test_every_query_has_sql_but_three():
    """Ties that these break have no equal in SQL; properties are checked below."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"r22_choose_random", "r23_choose_covering", "r28_quadratic_split"}


def test_queries_without_sql(spark):
    """A child of its own node for each node; of a split each entry on one side."""
    entries = {(r["node_id"], r["ordinal"]) for r in catalogue.QUERIES["r28_quadratic_split"](spark, SF).collect()}
    nodes = {n for n, _ in entries}
    assert len(entries) == 51 * len(nodes)
    for name in ("r22_choose_random", "r23_choose_covering"):
        rows = catalogue.QUERIES[name](spark, SF).collect()
        assert {r["node_id"] for r in rows} == nodes and len(rows) == len(nodes)
        assert all((r["node_id"], r["ordinal"]) in entries for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_ranks_are_those_of_the_loaded_keys(spark, sf):
    path = f"/root/testdata/{sf}"
    n = spark.read.parquet(f"{path}/orders.parquet").count()
    for name, column in (("w03_scrambled_zipf", "key_index"), ("w04_latest", "key_index"), ("w27_mixes", "key_index"), ("w28_rank_hotspot_scans", "rank")):
        low, high = catalogue.QUERIES[name](spark, path).agg(F.min(column), F.max(column)).first()
        assert 0 <= low and 0.8 * n < high < n, name
