import pytest

from lamina.plans import catalogue
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def duck(small_dir):
    return connection(small_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, small_dir, name):
    df = catalogue.QUERIES[name](spark, small_dir)
    if name in catalogue.ORACLES:
        assert_same(df, duck, catalogue.ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry_module(spark, small_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_topk_plans(spark, small_dir):
    """Recency is a top-k over a pruned, filtered scan; no shuffle of the table."""
    plan = catalogue.QUERIES["recent_scope_kind"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)" in plan
