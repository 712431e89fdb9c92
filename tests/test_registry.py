import pytest

import __spark_entry__ as entry_points
import check
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_points.oracle_sql())
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["sales_group", "x_bin", "avg_norm_count"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    ok, note = check.compare(spark, db, SF, name)
    assert ok, note


def test_no_query_runs_python_workers(spark, plan):
    for name in QUERIES:
        text = plan(entry_points.queries()[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text
