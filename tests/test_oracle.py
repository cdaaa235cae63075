import pytest
from conftest import DATA
from oracle import check

from corpuswright.plans.catalogue import ORACLE, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name], DATA / "sf0.001")


def test_flagship_has_rows(spark):
    assert flagship(spark, str(DATA / "sf0.001")).count() > 0


def test_entry_points_list_the_queries():
    import __spark_entry__ as entry

    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
