"""Physical-plan properties that matter at scale: column pruning into the
parquet scans and no Python evaluation in the hot queries."""

import pytest

import __spark_entry__ as entry
from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f3_tract_year_metrics", "e6_opportunity_score", "d1_d8_financial_features",
                                  "b2_clean_hmda", "h2_h5_temporal_features"])
def test_no_python_udf_in_plan(spark, name):
    p = _plan(entry.queries()[name](spark, SF001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scans_read_only_needed_columns(spark):
    p = _plan(entry.queries()["f3_tract_year_metrics"](spark, SF001))
    assert "o_orderpriority" not in p and "o_orderstatus" not in p and "c_name" not in p
