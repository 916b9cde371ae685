import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import compare  # noqa: E402

from tallyforge.plans.queries import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, sf, con, name):
    same, extra, missing = compare.differences(QUERIES[name](spark, sf), con, ORACLE[name])
    assert same and not extra and not missing, (same, sum(extra.values()), sum(missing.values()), list(extra)[:3], list(missing)[:3])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
