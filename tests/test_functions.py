"""Expression-level tests on hand-made frames (expected values from the formulas)."""

import math

from pyspark.sql import functions as F

from tractlens.functions import parse
from tractlens.functions.columns import bands, clip, nan_mean, round2

DTI_TEXTS = ["<20%", "20%-<30%", "30%-<36%", "43", "50%-60%", ">60%", "Exempt"]


def _col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_dti_parsers_match_fixture_table(spark):
    # FIXTURES §2 dti_texts
    assert _col(spark, DTI_TEXTS, parse.dti_v1) == [15, 25, 33, 43, 55, 70, None]
    assert _col(spark, DTI_TEXTS, parse.dti_v2) == [15, 25, 33, 43, 55, 65, None]
    assert _col(spark, DTI_TEXTS, parse.dti_v3) == [15, 25, 33, None, 55, 70, None]
    assert _col(spark, DTI_TEXTS, parse.dti_v4) == [20, None, None, 43, None, 60, None]


def test_tract_key_normalisation(spark):
    out = _col(spark, ["20091050100.0", "NA", None, "Unknown", " 20001000003 "], parse.tract_key)
    assert out == ["20091050100", None, None, None, "20001000003"]


def test_ltv_v2_fraction(spark):
    assert _col(spark, ["80", "0.8", "95%", "Exempt", None], parse.ltv_v2) == [0.8, 0.8, 0.95, None, None]


def test_outcome_definitions(spark):
    acts = list(range(1, 9))
    assert _col(spark, acts, parse.approved_broad, "int") == [1, 1, 0, 0, 0, 1, 0, 1]
    assert _col(spark, acts, parse.denied_broad, "int") == [0, 0, 1, 0, 0, 0, 1, 0]
    assert _col(spark, acts, parse.model_target, "int") == [1, 1, 0, -1, -1, 1, 0, 1]


def test_clip_keeps_null_and_bands_are_right_closed(spark):
    assert _col(spark, [None, -1.0, 5.0, 11.0], lambda c: clip(c, 0, 10), "double") == [None, 0.0, 5.0, 10.0]
    labs = _col(spark, [0.0, 3.0, 3.5, 4.0, 9.0], lambda c: bands(c, [0, 3, 4, math.inf], ["a", "b", "c"]), "double")
    assert labs == [None, "a", "b", "b", "c"]


def test_round2_and_nan_mean(spark):
    assert _col(spark, [1.234, 1.235, -1.005], round2, "double") == [1.23, 1.24, -1.0]
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(nan_mean([F.col("a"), F.col("b")])).collect()] == [1.0, None, 3.0]


def test_prediction_features_depend_on_their_own_row(spark):
    from pyspark.sql import functions as F

    from conftest import SF001
    from tractlens.operators import features as fe
    from tractlens.sources.tables import applications

    cols = ["application_id", "income", "loan_amount", "property_value", "debt_to_income_ratio", "loan_to_value_ratio",
            "interest_rate", "loan_term", "applicant_sex"]
    apps = applications(spark, SF001).select(*cols).orderBy("application_id").limit(40).cache()
    together = {r["application_id"]: r for r in fe.prediction_features(apps).collect()}
    half = fe.prediction_features(apps.filter(F.col("application_id") % 2 == 0)).collect()
    assert half and all(together[r["application_id"]] == r for r in half)
    assert len({r["dti_risk_category_encoded"] for r in together.values()}) > 2


def test_prepared_features_have_no_gaps(spark):
    from tractlens.operators import features as fe

    rows = [(1, 40.0, None, "a"), (2, float("inf"), 700.0, None), (None, None, 650.0, "b"), (4, 20.0, 700.0, "a")]
    df = spark.createDataFrame(rows, "application_id long, debt_to_income_ratio double, credit_score_proxy double, city string")
    out, names = fe.prepare_for_modeling(df)
    assert names == ["debt_to_income_ratio", "credit_score_proxy", "city_encoded"]
    got = out.collect()
    assert all(r[n] is not None and abs(r[n]) < 1e6 for r in got for n in names)
    assert {r["application_id"] for r in got} == {1, 2, 4, None}
    assert {r["city"]: r["city_encoded"] for r in got} == {"a": 0, "b": 1, None: 2}
