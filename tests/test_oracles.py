"""Every query with an oracle gives the oracle's rows; the others give rows twice alike."""

import os

import duckdb
import pytest

from corvina import catalog

DATA, SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"), "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return connection


def _plain(value):
    return None if value is None or value != value else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted([tuple(str(_plain(row[c])) for c in columns) for row in df.collect()])
    result = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted(tuple(str(_plain(row[i])) for i in order) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_repeatable(spark, name):
    first, second = (sorted(map(str, catalog.QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert first == second
