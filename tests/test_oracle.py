import pytest

import __spark_entry__ as entry
import cairn.plans.more  # noqa: F401
import cairn.plans.texts  # noqa: F401
from cairn.plans.catalog import ORACLE, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, sf_dir, name):
    compare(spark, name, QUERIES[name], ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
