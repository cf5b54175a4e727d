import pytest

from lexweft.plans import registry

from .oracle import check


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, name):
    if name in registry.ORACLES:
        check(spark, small, registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query", "entity_id", "score", "matched", "rank"] and df.count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLES) <= set(e.oracle_sql())
