import pytest

from basetrack import queries as Q
from tests.compare import canonical, sql_rows

SF = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", Q.queries())
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in SQL:
        names, expected = sql_rows(SF, SQL[name])
        assert canonical(df.columns, rows) == canonical(names, expected)
