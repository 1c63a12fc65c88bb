"""Fitted stages: scalers, one-hot state, the saved preprocessor, old predictor features."""

import math
import statistics
import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF001
from tractlens.operators import features as fe
from tractlens.operators import preprocess as pp
from tractlens.plans.preprocess import before_last_year
from tractlens.plans.validation import model_input

ROWS = [(1, 2.0, 5.0, "b"), (2, 4.0, 5.0, "a"), (3, None, 5.0, "c"), (4, 9.0, 5.0, None), (5, float("nan"), 5.0, "a"),
        (6, float("inf"), 5.0, "b")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "id int, x double, same double, kind string")


@pytest.mark.parametrize("method, center, scale", [
    ("standard", 5.0, statistics.pstdev([2, 4, 9])), ("minmax", 2.0, 7.0), ("robust", 4.0, 3.5)])
def test_scalers_learn_from_finite_values(small, method, center, scale):
    model = pp.Scaler(inputCols=["x", "same"], method=method).fit(small)
    got = [r["x"] for r in model.transform(small).orderBy("id").collect()]
    assert got[2] is None and got[4] is None and got[5] is None
    assert [got[i] for i in (0, 1, 3)] == pytest.approx([(v - center) / scale for v in (2, 4, 9)])
    assert {r["same"] for r in model.transform(small).collect()} == {0.0}  # a scale of 0 is 1
    filled = pp.Scaler(inputCols=["x"], method=method, nulls="center").fit(small).transform(small)
    assert filled.filter("x IS NULL").count() == 0 and filled.filter("id = 3").first()["x"] == 0.0


def test_scaler_without_rows_or_with_an_unknown_method(spark, small):
    empty = pp.Scaler(inputCols=["x"]).fit(small.limit(0))
    assert empty.learned() == {"x": [0.0, 1.0]}
    assert [r["x"] for r in empty.transform(small.filter("id = 1")).collect()] == [2.0]
    with pytest.raises(ValueError):
        pp.Scaler(inputCols=["x"], method="log")


def test_one_hot_keeps_the_training_columns(spark, small):
    model = pp.OneHot(inputCols=["kind"]).fit(small)
    new = spark.createDataFrame([(1, "c"), (2, "unheard of"), (3, "a"), (4, None)], "id int, kind string")
    out = model.transform(new).orderBy("id")
    assert out.columns == ["id", "kind_b", "kind_c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 1), (0, 0), (0, 0), (0, 0)]
    # A column that new rows lack altogether is as if it were null.
    assert [tuple(r) for r in model.transform(new.select("id").filter("id = 1")).collect()] == [(1, 0, 0)]


def test_sparse_vector_has_the_same_slots(spark, small):
    columns = pp.OneHot(inputCols=["kind", "id"]).fit(small)
    sparse = pp.OneHot(inputCols=["kind", "id"], vectorCol="hot").fit(small)
    dense = columns.transform(small.withColumn("at", F.col("id"))).orderBy("at").drop("at", "x", "same").collect()
    slots = sparse.transform(small).orderBy("id").select(vector_to_array("hot").alias("v")).collect()
    assert [tuple(r) for r in dense] == [tuple(int(v) for v in r["v"]) for r in slots]


def test_too_many_categories_raise(small):
    with pytest.raises(ValueError, match="kind"):
        pp.OneHot(inputCols=["kind"], maxCategories=2).fit(small)


def test_saved_preprocessor_in_a_new_session(spark):
    old, new = before_last_year(model_input(spark, SF001))
    path = tempfile.mkdtemp(prefix="tl-prep-")
    fitted = pp.preprocessor().fit(old)
    fitted.write().overwrite().save(path)
    other = spark.newSession()
    rows = model_input(other, SF001)
    again = pp.transform_new_data(rows.filter(F.col("activity_year") == rows.agg(F.max("activity_year")).first()[0]), path)
    here = fitted.transform(new)
    assert again.columns == here.columns and again.count() == new.count() > 0
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(again) == key(here)
    # One row alone gets what it gets among others: nothing is learned from new rows.
    one = new.limit(1)
    assert key(PipelineModel.load(path).transform(one))[0] in key(here)


def test_old_predictor_features_by_hand(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 50.0, 200.0, 1), (2, None, 0.0, 0.0, 3), (3, 300.0, None, 100.0, 7)],
        "application_id int, loan_amount double, income double, property_value double, action_taken int")
    got = {r["application_id"]: r for r in fe.old_predictor_features(df).collect()}
    # Medians 200 / 25 / 100; then quantiles 0.1 % and 99.9 % hold the ends.
    ratios = [100 / 50, 200 / 1, 300 / 25]
    lo, hi = (sorted(ratios)[0] + 0.002 * (sorted(ratios)[1] - sorted(ratios)[0]), sorted(ratios)[2] - 0.002 * (sorted(ratios)[2] - sorted(ratios)[1]))
    assert got[1]["loan_to_income_ratio"] == pytest.approx(lo) and got[2]["loan_to_income_ratio"] == pytest.approx(hi)
    assert [got[i]["loan_approved"] for i in (1, 2, 3)] == [1, 0, 0] and [got[i]["loan_denied"] for i in (1, 2, 3)] == [0, 1, 0]
    assert all(-1 <= got[i]["down_payment_ratio"] <= 1 and not math.isnan(got[i]["income"]) for i in got)
