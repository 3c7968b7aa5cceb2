"""Every registered query: runs, has rows, and equals its oracle where it has one."""

import oracle
import pytest

from quillspark.plans import catalog

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return oracle.connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data_dir, con):
    df = QUERIES[name](spark, data_dir)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
