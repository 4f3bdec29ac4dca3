"""Every registered query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest

import check
from estatelens.plans import catalog
from estatelens.plans.views import TABLES, VIEWS, view

FOLDER = os.environ.get("ESTATE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view_is_equal_in_both_engines(spark, con, name):
    want = con.execute(f"WITH v AS ({VIEWS[name]}) SELECT * FROM v").fetchall()
    got = [tuple(r) for r in view(spark, FOLDER, name).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, FOLDER, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok is not False, note


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES


def test_whole_hybrid_search_goes_past_rank_50(spark):
    whole, first = ({(r["query_id"], r["id"]) for r in catalog.QUERIES[name](spark, FOLDER).collect()} for name in ("hybrid_search_whole", "hybrid_search"))
    assert len(whole) == len(first) == 50 and whole - first
