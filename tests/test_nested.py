"""Nested and sorted files, the state filter."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from tractlens.plans.temporal import yearly
from tractlens.plans.yoy import metrics
from tractlens.sources import files, nested

SCHEMA = "year int, census_tract string, opportunity_score double, tags array<string>, more struct<a: int>"
ROWS = [(2000, "b", 1.5, ["x", None], (1,)), (2000, "a", None, None, None), (2001, "a", float("inf"), [], (None,)), (None, "c", 0.1 + 0.2, ["ä\n"], (3,)),
        (2000, "a", None, None, None)]


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="tl-nested-"), "out")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_nested_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for block_rows in (1, 100):
        path = folder()
        nested.write_nested(df, path, block_rows=block_rows)
        assert rows(nested.read_nested(spark, path, df.schema)) == rows(df)
    assert "data_by_year" in spark.read.text(path).first()[0]
    y = yearly(spark, SF001)
    path = folder()
    nested.write_nested(y, path, block_rows=10)
    assert rows(nested.read_nested(spark, path, y.schema)) == rows(y)
    assert spark.read.text(path).count() > y.select("year").distinct().count()  # several blocks a year


def test_result_files(spark):
    scores = spark.createDataFrame([("a", 2000, 10.0), ("b", 2000, 30.0), ("a", 2001, 20.0)], "census_tract string, year int, opportunity_score double")
    predictions = spark.createDataFrame([("a", 2002, 70.0), ("b", 2002, 69.0)], "census_tract string, year int, predicted_opportunity_score double")
    scored = spark.createDataFrame([(2000, "gbt", 0.5, 2.0, 1.0), (2000, "random_forest", 0.7, 1.0, 0.5), (2001, "gbt", 0.5, 2.0, 1.0),
                                    (2001, "random_forest", 0.5, 3.0, 2.0)], "year int, model string, r2 double, mse double, mae double")
    out = folder()
    nested.save_results(out, scores, predictions, scored, 7)
    read = lambda *p: spark.read.json(os.path.join(out, *p))
    r = read("results").first()
    assert (r["yearly_data_loaded"], r["models_trained"], r["predictions_generated"], r["timeline_records"]) == (2, 2, 1, 5)
    s = {x["year"]: x for x in read("historical", "summary").collect()}
    assert s[2000]["average_score"] == 20.0 and s[2000]["score_range"] == [10.0, 30.0] and s[2001]["census_tracts"] == 1
    assert read("predictions", "summary").first()["high_opportunity_tracts"] == 1
    p = {x["year"]: x for x in read("performance").collect()}
    assert p[2000]["best_model"] == "random_forest" and p[2000]["r2_score"] == 0.7 and p[2001]["best_model"] == "gbt"
    assert p[2000]["model_details"]["gbt"]["mse"] == 2.0 and p[2001]["feature_count"] == 7
    assert rows(nested.read_nested(spark, os.path.join(out, "predictions", "data"), predictions.schema)) == rows(
        predictions.select(*predictions.columns))


def test_export_job(spark):
    m = metrics(spark, SF001)
    out = folder()
    nested.export_yoy(m, out)
    assert nested.read_nested(spark, os.path.join(out, "analysis"), m.schema).count() == m.count()
    assert files.read_csv(spark, os.path.join(out, "segments")).columns[:2] == ["year", "market_segment"]


def test_sorted_files_do_not_overlap(spark):
    y = yearly(spark, SF001).select("census_tract", "year", "opportunity_score").repartition(5)
    for fmt in ("parquet", "csv"):
        path = folder()
        nested.write_sorted(y, path, fmt=fmt, file_rows=10)
        back = spark.read.option("header", True).option("inferSchema", True).format(fmt).load(path)
        assert back.count() == y.count()
        ends = back.groupBy(F.input_file_name().alias("f")).agg(F.min("census_tract").alias("a"), F.max("census_tract").alias("z"),
                                                                F.min(F.struct("census_tract", "year")).alias("lo"),
                                                                F.max(F.struct("census_tract", "year")).alias("hi")).orderBy("f").collect()
        assert len(ends) > 2 and all(tuple(x["hi"]) < tuple(z["lo"]) for x, z in zip(ends, ends[1:]))


def test_state_filter(spark):
    df = spark.createDataFrame([("20", 20, "KS"), ("08", 8, "CO"), ("8", 8, "CO"), (None, None, None)], "t string, n int, state_abbr string")
    assert files.state_rows(df, 8, "t").count() == 2 and files.state_rows(df, "08", "n").count() == 2
    assert files.state_rows(df, "KS", "state_abbr").count() == 1 and files.state_rows(df, 20, "t").count() == 1
