"""Every query of the engine against DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from sourcesieve.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("SIEVE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "conversations", "benchmark", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_all_have_oracles():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        answer = db.execute(ORACLES[name])
        columns = [c[0] for c in answer.description]
        want = answer.fetchall()
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
