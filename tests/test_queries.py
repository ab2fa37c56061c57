"""Every registered transcript query against DuckDB on the smallest tables."""

import pytest
from conftest import comparable

from auricle.plans import queries, sql


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, data_dir, name):
    got = queries.QUERIES[name](spark, data_dir).toArrow()
    assert got.num_rows > 0
    if name in sql.ORACLE_SQL:
        want = duck.execute(sql.ORACLE_SQL[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert comparable(got) == comparable(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
