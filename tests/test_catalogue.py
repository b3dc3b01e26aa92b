import os

import oracle
import pytest

from gleaner.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    assert (oracle.compare(df, con, sql) if sql else "" if df.count() >= 0 else "no rows") == ""


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["clip_id", "out", "in", "events", "net"]
    assert set(catalogue.queries()) <= set(entry.queries()) and set(catalogue.oracle_sql()) <= set(entry.oracle_sql())
