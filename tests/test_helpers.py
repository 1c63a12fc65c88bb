"""Helpers that no registered query calls: sources, sinks, rules, comparisons; validator cases."""

import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from tractlens.operators import dashboard as db
from tractlens.operators import features as fe
from tractlens.operators import ml
from tractlens.operators import rules as R
from tractlens.operators import tuning as tn
from tractlens.operators import validate as v
from tractlens.plans.models import FEATURES, labelled
from tractlens.sources import files, sinks
from tractlens.sources.tables import applications


def folder():
    return tempfile.mkdtemp(prefix="tl-helpers-")


def test_yearly_files_are_read_as_far_as_they_exist(spark):
    d = folder()
    apps = applications(spark, SF001).select("application_id", "activity_year", "loan_amount", "income")
    paths = {y: os.path.join(d, f"{y}") for y in (1997, 1998, 1999)}
    sinks.write_csv(apps.filter("activity_year = 1997"), paths[1997])
    sinks.write_csv(apps.filter("activity_year = 1998").drop("income", "activity_year"), paths[1998])
    got = files.read_yearly(spark, paths)
    assert {(r["year"], r["n"]) for r in got.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        (y, apps.filter(F.col("activity_year") == y).count()) for y in (1997, 1998)}
    assert got.filter("year = 1998 AND income IS NOT NULL").count() == 0 and got.filter("activity_year IS NULL").count() == 0
    assert files.read_yearly(spark, {1999: paths[1999]}) is None
    assert files.first_existing(spark, [paths[1999], paths[1998], paths[1997]]) == paths[1998]
    assert files.first_existing(spark, [paths[1999]]) is None


def test_projected_scan(spark):
    a = applications(spark, SF001)
    assert files.projected(a, ["application_id", "income"]).columns == ["application_id", "income"]
    assert files.projected(a, ["application_id"], 7).count() == 7


def test_model_round_trip_and_reports(spark):
    d = labelled(spark, SF001)
    found = tn.train_configured(d.filter("is_test = 0"), FEATURES, "application_id",
                                {"algorithm": "random_forest", "params": {"numTrees": 5, "maxDepth": 3}})
    path = os.path.join(folder(), "model")
    sinks.save_model(found.model, path)
    test = ml._numeric(d.filter("is_test = 1"), FEATURES)
    again = sinks.load_pipeline_model(path).transform(test)
    key = lambda df: sorted((r["application_id"], r["prediction"], tuple(r["probability"])) for r in df.collect())
    assert key(again) == key(found.model.transform(test))
    metrics = ml.classification_metrics(again, "label", "forest")
    report = sinks.training_report(metrics, {"rows": test.count()})
    assert '"model": "forest"' in report and f'"rows": {test.count()}' in report
    text = sinks.validation_report_markdown(v.validation_report(applications(spark, SF001), "hmda"), "Report")
    assert text.startswith("# Report") and "## hmda" in text
    out = os.path.join(folder(), "deep", "report.md")
    sinks.write_text(out, text)
    assert open(out, encoding="utf-8").read() == text
    compared = ml.method_comparison(metrics, metrics.withColumn("f1", F.col("f1") * 1.5)).first()
    assert compared["f1_gain_pct"] == pytest.approx(50.0)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_code_tables_and_bands(spark):
    r = one(spark, R.action_label(F.lit(3)), R.action_label(F.lit(99)), R.credit_band_score(F.lit("Good (670-739)")),
            R.credit_band_score(F.lit("?")), R.probability_band(F.lit(69.9)), R.probability_band(F.lit(70)), R.confidence_band(F.lit(59)),
            R.confidence_band(F.lit(80)))
    assert tuple(r) == ("Application denied", "Unknown action", 705, 700, "Medium", "High", "Low", "High")
    df = R.add_missing_columns(spark.range(1), {"id": 5, "x": 1.5, "t": "a"})
    assert tuple(df.first()) == (0, 1.5, "a") and R.add_missing_columns(df, {"x": 2.0}) is df
    assert db.column_set_diff(["a", "b"], ["b", "c"]) == {"common": ["b"], "missing": ["c"], "extra": ["a"]}


def test_hybrid_reasons_by_case(spark):
    rules, model = [R.R_DTI, R.R_CREDIT, R.R_LTV], ["Debt-to-income ratio", "Credit history", "Collateral"]
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    case = lambda d, l_, s, rs=rules, ms=model: list(one(spark, R.hybrid_reasons(lit(rs), lit(ms), F.lit(d), F.lit(l_), F.lit(s)))[0])
    assert case(55.0, 80.0, 700.0) == [R.R_DTI, R.R_CREDIT, "Collateral (ML confirmed)"]
    assert case(40.0, 80.0, 700.0)[0] == "Debt-to-income ratio" and len(case(40.0, 80.0, 700.0)) == 3
    assert case(30.0, 80.0, 600.0)[0] == "Credit history"
    assert case(30.0, 80.0, 700.0) == [R.R_DTI, R.R_CREDIT, "Collateral"]
    assert case(30.0, 80.0, 700.0, [], []) == [R.R_OTHER] and case(55.0, 80.0, 700.0, [], []) == [R.R_OTHER]
    assert case(30.0, 80.0, 600.0, [R.R_LTV], []) == [R.R_LTV]


def test_all_risk_tiers(spark):
    df = spark.createDataFrame([(700, 40.0, 96.0, 4.5), (None, None, None, None)],
                               "credit_score int, debt_to_income_ratio double, loan_to_value_ratio double, loan_to_income_ratio double")
    full, empty = (r["risk_factors"].asDict() for r in fe.risk_tiers(df).collect())
    assert full == {"credit_risk": "Medium", "dti_risk": "High", "ltv_risk": "Very High", "lti_risk": "High"}
    assert set(empty.values()) == {None}


def test_validator_on_infinities_halves_and_short_texts(spark):
    """Infinite amounts, halves in whole-number columns, texts of no value."""
    a = applications(spark, SF001).limit(6).withColumn("n", F.row_number().over(Window.orderBy("application_id")))
    odd = a.withColumns({
        "loan_amount": F.when(F.col("n") == 1, F.lit(float("inf"))).when(F.col("n") == 2, F.lit(float("nan"))).otherwise(F.col("loan_amount")),
        "income": F.when(F.col("n") == 1, F.lit(float("-inf"))).otherwise(F.col("income")),
        "loan_term": F.when(F.col("n") == 3, F.lit(180.5)).otherwise(F.col("loan_term").cast("double")),
        "census_tract": F.when(F.col("n") == 4, F.lit("nan")).when(F.col("n") == 5, F.lit("")).otherwise(F.col("census_tract")),
    }).drop("n")
    clean, report = v.validate_dataframe(odd, "hmda")
    rows = clean.collect()
    assert len(rows) == 6
    for r in rows:
        assert r["loan_amount"] is not None and abs(float(r["loan_amount"])) < float("inf") and r["loan_amount"] == r["loan_amount"]
    assert report.filter("severity IN ('error', 'warning')").count() > 0
