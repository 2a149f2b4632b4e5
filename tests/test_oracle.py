"""Every registered query against its DuckDB oracle on the smallest driver tables (the driver
runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from kbspark.plans import oracle, queries as plans
from conftest import SF_SMALL
from oracle_check import check

NAMES = sorted(plans.queries())


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(plans.queries()) - set(oracle.oracle_sql())
    assert rows_only <= {"vector_ivf_topk", "importance_lsh"}
    assert set(oracle.oracle_sql()) <= set(plans.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "query_id"
    assert df.count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = check(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] in ("ok", "rows_only"), res
