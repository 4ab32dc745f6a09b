"""Every registered query against its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from contract import oracles, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
GIVEN = ("customer", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_same_keys():
    assert set(queries.queries()) == set(oracles.oracle_sql())


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, duck):
    df = queries.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(columns).collect())
    cursor = duck.execute(oracles.oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    rows = cursor.fetchall()
    assert columns == sorted(described)
    names = list(described)
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in order) for r in rows)
    assert sum(got.values()) == sum(expected.values())
    missing, extra = list((expected - got).items())[:5], list((got - expected).items())[:5]
    assert not missing and not extra, (columns, missing, extra)
    assert {c: TYPES[t] for c, t in df.dtypes} == described
