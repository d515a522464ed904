import pytest
from conftest import SMALL, same

from lodestream import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, oracle, name):
    df = plans.queries()[name](spark, SMALL)
    if name in SQL:
        same(df, oracle, SQL[name])
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
