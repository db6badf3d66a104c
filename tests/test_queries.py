"""Every query that has SQL gives the rows of that SQL on the smallest data set; the entry points hold."""

from __future__ import annotations

import json
import math

import duckdb
import pytest
from conftest import TABLES

import __spark_entry__ as entry
from siltstone import queries as own
from siltstone.operators import nearest

QUERIES, SQL = own.QUERIES, own.SQL


def plain(value):
    if isinstance(value, float):
        return round(value, 5) if math.isfinite(value) else str(value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 5)
    return value if isinstance(value, (int, str, type(None))) else str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((plain([r[c] for c in columns]) for r in df.collect()), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((plain([r[i] for i in at]) for r in result.fetchall()), key=repr)


def test_snippets_hold_the_terms(spark, small):
    rows = entry.queries()["snippets"](spark, small).collect()
    assert len(rows) == 20 and sorted(r["rank"] for r in rows) == list(range(1, 21))
    for r in rows:
        parts = json.loads(r["snippets"])
        assert 1 <= len(parts) <= 2
        for p in parts:
            assert len(p["text"]) <= 60 and all(p["text"].encode()[x["start"] : x["end"]].decode().lower() in ("the", "of") for x in p["ranges"])


def test_approximate_neighbours_are_nearly_the_exact_ones(spark, small):
    got = {r["vec_id"] for r in entry.queries()["ann_preview"](spark, small).collect()}
    best = nearest.exact(spark.read.parquet(f"{small}/embeddings.parquet"), "vec_id", "embedding", own.first_vector(spark, small), 10).collect()
    assert len(got & {r["vec_id"] for r in best}) >= 9 and len(got) == 10


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) == {"snippets", "ann_preview", "compare_analyzers"}


def test_entry_points(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
