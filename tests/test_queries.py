"""Every query that does not depend on the optional parts against its SQL."""

import pytest

import __spark_entry__ as entry
from millrace.operators import hierarchy
from millrace.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connection, same

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF_DIR), con, ORACLE_SQL[name])


def test_cumulative_share_keeps_every_source(spark):
    sf_dir = "/root/testdata/sf0.01"
    same(QUERIES["w5_cumulative_share_all"](spark, sf_dir), connection(sf_dir), ORACLE_SQL["w5_cumulative_share_all"])
    rows = QUERIES["w5_cumulative_share_all"](spark, sf_dir).collect()
    assert len(rows) > 50 and max(r["percent"] for r in rows) == 100


def test_closure_raises_beyond_its_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "child long, parent long")
    assert hierarchy.closure(edges, max_depth=3).count() == 10
    with pytest.raises(ValueError, match="max_depth=2"):
        hierarchy.closure(edges, max_depth=2)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
