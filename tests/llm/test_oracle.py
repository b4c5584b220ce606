import pytest

from cairn.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf_dir)
