import pytest
from oracle import oracle_rows, spark_rows

from quern import content_queries, more_queries  # noqa: F401
from quern.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    got = spark_rows(spark, SF, QUERIES[name])
    if name in ORACLE_SQL:
        assert got == oracle_rows(SF, ORACLE_SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 189
