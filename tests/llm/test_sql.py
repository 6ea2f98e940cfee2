import pytest

from basetrack.llm.queries import oracle_sql, queries
from tests.compare import canonical, sql_rows


@pytest.mark.parametrize("name", oracle_sql())
def test_query(spark, name):
    df = queries()[name](spark, "/root/testdata/sf0.01")
    names, expected = sql_rows("/root/testdata/sf0.01", oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, expected)
