"""Sources, sinks and the streaming entry point."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from tractlens.operators import rules as R
from tractlens.operators import validate as v
from tractlens.sources import files, sinks
from tractlens.sources.tables import applications
from tractlens.streaming import scoring


def test_census_api_json_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tl-census-")
    rows = [["B01003_001E", "B19013_001E", "B23025_003E", "B23025_005E", "B25003_002E", "B25003_003E",
             "state", "county", "tract"],
            ["4000", "55000", "833", "45", "900", "300", "20", "91", "50100"],
            ["-666666666", "61000", "1000", "50", "0", "0", "20", "91", "50200"]]
    with open(os.path.join(d, "c.json"), "w") as fh:
        json.dump(rows, fh)
    out = {r["census_tract"]: r for r in files.census_api_json(spark, d, year=2023).collect()}
    a = out["20091050100"]
    assert a["unemployment_rate"] == 5.4 and a["total_population"] == 4000.0 and a["year"] == 2023
    assert out["20091050200"]["total_population"] is None
    assert out["20091050200"]["homeownership_rate"] is None


def test_combine_keeps_common_columns_and_dedups(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id int, t string, v double")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "id int, t string")
    out = files.combine_frames([a, b])
    assert out.columns == ["id", "t"] and sorted(r["id"] for r in out.collect()) == [1, 2, 3]


def test_csv_sink_refuses_to_overwrite_its_input(spark):
    d = tempfile.mkdtemp(prefix="tl-sink-")
    p = os.path.join(d, "apps")
    df = applications(spark, SF001).limit(50)
    sinks.write_csv(df, p)
    back = files.read_csv(spark, p)
    try:
        sinks.write_csv(back, p)
        raise AssertionError("overwrite of input allowed")
    except ValueError:
        pass


def test_forecast_sink_partitions_records_by_year(spark):
    d = tempfile.mkdtemp(prefix="tl-fc-")
    pred = spark.createDataFrame([("a", 2025, 71.0), ("b", 2025, 40.0), ("a", 2026, 75.0)],
                                 "census_tract string, year int, predicted_opportunity_score double")
    sinks.save_forecast_results(pred, d)
    summ = {r["year"]: r for r in files.read_json_records(spark, os.path.join(d, "summary")).collect()}
    assert summ[2025]["count"] == 2 and summ[2025]["high_count"] == 1
    assert files.read_json_records(spark, os.path.join(d, "records")).count() == 3


def test_rule_denial_reasons_fixture_cases(spark):
    # FIXTURES §2 hi_1 / lo_1 style rows (DTI %, LTV %, score, income $, loan, value)
    df = spark.createDataFrame([(65.0, 98.0, 600.0, 30000.0, 190000.0, 200000.0),
                                (25.0, 75.0, 780.0, 100000.0, 225000.0, 300000.0)],
                               "d double, l double, s double, i double, a double, v double")
    out = df.select(R.rule_denial_reasons(F.col("d"), F.col("l"), F.col("s"), F.col("i"), F.col("a"), F.col("v"))
                    .alias("r")).collect()
    assert out[0]["r"] == [R.R_DTI_50, R.R_CREDIT, R.R_LTV]
    assert out[1]["r"] == [R.R_OTHER]


def test_streaming_scoring_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="tl-stream-src-")
    apps = applications(spark, SF001)
    apps.write.mode("overwrite").parquet(os.path.join(src, "part"))
    stream = scoring.application_stream(spark, os.path.join(src, "part"), apps.schema)
    q = scoring.start_scoring(spark, stream, "", os.path.join(src, "ckpt"), name="scoring_test", fmt="memory")
    q.awaitTermination(120)
    got = spark.sql("SELECT count(*) AS n, sum(credit_score_proxy) AS s FROM scoring_test").collect()[0]
    exp = scoring.score_applications(apps).agg(F.count(F.lit(1)).alias("n"),
                                               F.sum("credit_score_proxy").alias("s")).collect()[0]
    assert got["n"] == exp["n"] and abs((got["s"] or 0) - (exp["s"] or 0)) < 1e-6


def test_stream_restart_writes_no_duplicates(spark):
    d = tempfile.mkdtemp(prefix="tl-stream-")
    src, sink, ckpt = (os.path.join(d, x) for x in ("src", "sink", "ckpt"))
    apps = applications(spark, SF001)
    apps.filter("application_id % 2 = 0").write.parquet(os.path.join(src))
    for _ in range(2):  # the second start finds nothing new
        scoring.start_scoring(spark, scoring.application_stream(spark, src, apps.schema), sink, ckpt).awaitTermination(120)
    apps.filter("application_id % 2 = 1").write.mode("append").parquet(src)
    scoring.start_scoring(spark, scoring.application_stream(spark, src, apps.schema), sink, ckpt).awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == apps.count() == out.select("application_id").distinct().count()


def test_dti_labels_are_parsed_before_they_are_judged(spark):
    apps = applications(spark, SF001).limit(1).drop("debt_to_income_ratio")
    labels = {"<20%": 15.0, "20%-<30%": 25.0, "30%-<36%": 33.0, "36": 36.0, "44.5": 44.5, "50%-60%": 55.0, ">60%": 65.0,
              "Exempt": None, None: None}
    rows = spark.createDataFrame([(t,) for t in labels], "debt_to_income_ratio string").crossJoin(apps)
    out = scoring.score_applications(rows.withColumn("application_id", F.monotonically_increasing_id()))
    clean = v.clean_dataframe(rows, "hmda").select("debt_to_income_ratio")
    assert sorted((r[0] for r in clean.collect()), key=repr) == sorted(labels.values(), key=repr)
    tiers = {r["debt_to_income_ratio"]: r["risk_factors"]["dti_risk"] for r in out.collect()}
    assert tiers[65.0] == "Very High" and tiers[15.0] == "Low" and tiers[None] != "Low"
