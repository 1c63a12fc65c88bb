"""Forecast rules on small fixed frames."""

from pyspark.sql import functions as F

from tractlens.operators import forecast as fc
from tractlens.operators import temporal as tm


def test_confidence_by_score_and_its_band(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,), (70.0,), (75.0,), (81.0,), (98.0,)], "predicted_opportunity_score double")
    got = fc.with_confidence(df).collect()
    assert [round(r["prediction_confidence"], 6) for r in got] == [70.0, 100.0, 100.0, 100.0, 100.0, 100.0, 80.0, 80.0]
    assert (got[0]["confidence_low"], got[0]["confidence_high"]) == (8.5, 11.5)
    fixed = df.select(*[c.alias(n) for c, n in zip(tm.confidence_band(F.col("predicted_opportunity_score"), width=10), ("lo", "hi"))]).collect()
    assert (fixed[0]["lo"], fixed[-1]["hi"]) == (0.0, 100.0)


def test_insight_table(spark):
    rows = [(t, h, s) for t, ss in (("a", (50.0, 60.0)), ("b", (70.0, 40.0)), ("c", (80.0, 80.0))) for h, s in zip((1, 3), ss)]
    df = spark.createDataFrame(rows, "census_tract string, years_ahead int, predicted_opportunity_score double")
    df = df.withColumn("predicted_opportunity_level", F.when(F.col("predicted_opportunity_score") >= 60, "High").otherwise("Low"))
    got = {(r["insight"], r["years_ahead"], r["key"]): r["value"] for r in fc.forecast_insights(df).collect()}
    assert got["level_count", 1, "High"] == 2 and got["level_count", 3, "Low"] == 1
    assert got["score_mean", 1, None] == 66.67 and got["score_std", 3, None] == 20.0 and got["total_tracts", None, None] == 3
    assert got["top_improving", None, "a"] == 10.0 and got["top_declining", None, "b"] == -30.0


def test_inputs_keep_rows_with_most_values_and_fill_medians(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 4.0, 5.0), (3, None, None, 9.0), (4, 3.0, 8.0, None)],
                               "id int, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in fc.forecast_inputs(df, ["a", "b", "c"]).collect()}
    # 70 % of three inputs are all three.
    assert got == {1: (1.0, 2.0, 3.0)}
    wide = df.withColumns({"d": F.lit(1.0), "e": F.lit(2.0)})
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in fc.forecast_inputs(wide, ["a", "b", "c", "d", "e"]).collect()}
    assert got == {1: (1.0, 2.0, 3.0), 2: (2.0, 4.0, 5.0), 4: (3.0, 8.0, 4.0)}
