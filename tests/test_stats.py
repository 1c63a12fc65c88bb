"""Exact medians and quantiles by value counts agree with Spark's single-buffer percentile."""

import math
import random

from pyspark.sql import functions as F

from tractlens.functions.stats import exact_quantiles, grouped_agg_with_medians, quantile_row, quantiles
from tractlens.operators import validate as v
from tractlens.operators.features import impute_for_model


def _frame(spark):
    random.seed(7)
    rows = [("a" if i % 3 else "b", random.choice([1.0, 2.0, 3.5, float(i), -float(i) / 7, None, float("nan")]), float(i % 7))
            for i in range(3000)]
    rows += [("c", 5.0, None), ("c", 1.0, 2.0), (None, 3.0, 1.0), (None, 4.0, None), ("d", None, None)]
    return spark.createDataFrame(rows, "k string, x double, y double")


def _clean(c):
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(b)))


def test_grouped_medians_are_exact_and_keep_null_keys(spark):
    df = _frame(spark)
    got = grouped_agg_with_medians(df, ["k"], [F.count(F.lit(1)).alias("n")], {"mx": F.col("x"), "my": F.col("y")})
    exp = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.median(_clean("x")).alias("mx"), F.median("y").alias("my"))
    assert sorted(got.collect(), key=repr) == sorted(exp.collect(), key=repr)


def test_quantiles_of_several_metrics_together(spark):
    df, probs = _frame(spark), [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    arr = F.array(*[F.lit(p) for p in probs])
    exp = {(r["k"], m): r[m] for r in df.groupBy("k").agg(
        F.percentile(_clean("x"), arr).alias("x"), F.percentile("y", arr).alias("y")).collect() for m in ("x", "y")}
    got = {(r["k"], r["_metric"]): r for r in quantiles(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, probs).collect()}
    assert {key for key, q in exp.items() if q is not None} == set(got)
    for key, r in got.items():
        assert all(_close(r[f"q{i}"], exp[key][i]) for i in range(len(probs)))


def test_extreme_values_and_empty_input(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1e-300, float("inf"), float("-inf"), 2.0, 2.0000000000000004]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    ranked = sorted(values)
    n = len(values) - 1
    row = quantile_row(df, {"x": F.col("x")}, [i / n for i in range(n + 1)]).first()
    assert [row[f"x__q{i}"] for i in range(n + 1)] == ranked
    none = exact_quantiles(df.limit(0), "x", [0.5]).collect()
    assert len(none) == 1 and none[0]["q0"] is None


def test_half_of_the_rows_tie_and_no_window_sees_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(36.0)).otherwise(F.col("id").cast("double")).alias("x"))
    out = exact_quantiles(df, "x", [0.5])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Every window stands above an aggregate that counts equal values.
    assert "Window" in plan and plan.rindex("Aggregate") > plan.rindex("Window")
    assert out.first()["q0"] == df.agg(F.median("x")).first()[0]


def test_stats_start_no_job_while_planning(spark):
    group = "planning"
    spark.sparkContext.setJobGroup(group, group)
    grouped_agg_with_medians(_frame(spark), ["k"], [F.count(F.lit(1)).alias("n")], {"m": F.col("x")})
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    assert len(ids) == 0


def test_imputation_leaves_keys_and_bounds_infinity(spark):
    rows = [(i, 2000, float(i), 1.0 if i % 3 else 2.0) for i in range(1, 101)] + [
        (None, None, None, None), (101, 2000, float("inf"), float("-inf")), (102, 2000, float("nan"), None)]
    df = spark.createDataFrame(rows, "application_id long, activity_year int, income double, score double")
    out = impute_for_model(df).collect()
    none = [r for r in out if r["application_id"] is None][0]
    assert none["activity_year"] is None and none["income"] == 50.5 and none["score"] == 1.0
    inf = [r for r in out if r["application_id"] == 101][0]
    assert math.isclose(inf["income"], 99.01) and inf["score"] == 1.0
    assert [r for r in out if r["application_id"] == 102][0]["income"] == 50.5


def test_profile_counts_distinct_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "b")], "x int, y string")
    got = {r["column"]: (r["null_count"], r["distinct_count"], r["pct_valid"]) for r in v.profile(df).collect()}
    assert got == {"x": (1, 2, 75.0), "y": (1, 2, 75.0)}
