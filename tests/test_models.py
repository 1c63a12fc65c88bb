"""Model helpers on the smallest driver tables: split stability, weights, logic check."""

from pyspark.sql import functions as F

from conftest import SF001
from tractlens.operators import ml
from tractlens.plans.models import FEATURES, labelled


#: A grid small enough for a test.
SMALL = {"random_forest": {"numTrees": [20], "maxDepth": [5, 8]}}


def test_split_is_deterministic_and_exact(spark):
    a, b = labelled(spark, SF001).collect(), labelled(spark, SF001).repartition(7).collect()
    assert {r["application_id"]: r["is_test"] for r in a} == {r["application_id"]: r["is_test"] for r in b}
    for label in (0.0, 1.0):
        marks = [r["is_test"] for r in a if r["label"] == label]
        assert sum(marks) == int(0.2 * len(marks) + 0.5)


def test_class_weights_balance(spark):
    d = ml.class_weights(labelled(spark, SF001), "label")
    tot = d.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    ws = [r["w"] for r in tot]
    assert abs(ws[0] - ws[1]) < 1e-6


def test_logic_check_on_fixture_cases(spark):
    d = labelled(spark, SF001).filter(F.col("is_test") == 0)
    models = ml.outcome_models(d, FEATURES, model_types=("random_forest",), grids=SMALL, folds=2, parallelism=2)
    # FIXTURES §2 hi_1, hi_2 (denied) and lo_1, lo_2 (approved); DTI / LTV in percent.
    cases = spark.createDataFrame(
        [(30.0, 190000.0, 200000.0, 600.0, 65.0, 98.0, 0.0), (40.0, 475000.0, 500000.0, 600.0, 55.0, 95.0, 0.0),
         (100.0, 225000.0, 300000.0, 780.0, 25.0, 75.0, 1.0), (85.0, 200000.0, 250000.0, 760.0, 30.0, 80.0, 1.0)],
        "income double, loan_amount double, property_value double, credit_score double, "
        "debt_to_income_ratio double, loan_to_value_ratio double, expected double")
    out = ml.logic_check(models["random_forest"].bestModel, cases, FEATURES).collect()[0]
    assert out["cases"] == 4 and 0.0 <= out["logic_score"] <= 1.0


def test_missing_inputs_are_imputed_for_the_model_but_never_tiered(spark):
    d = labelled(spark, SF001)
    models = ml.outcome_models(d.filter(F.col("is_test") == 0), FEATURES, model_types=("random_forest",),
                               grids=SMALL, folds=2, parallelism=2)
    gaps = d.limit(5).withColumns({c: F.lit(None).cast("double") for c in ("debt_to_income_ratio", "credit_score")})
    out = ml.batch_score(models["random_forest"].bestModel, gaps, FEATURES).collect()
    assert len(out) == 5
    assert all(r["risk_factors"]["dti_risk"] != "Low" and r["debt_to_income_ratio"] is None and r["credit_score"] is None for r in out)
    assert not any(c.startswith("_imp_") for c in out[0].asDict())
