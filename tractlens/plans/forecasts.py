"""Forecast tables on a forecast without a model:
the damped progression of each tract's score (L9), which SQL can compute too.  The same tables
over the fitted models are registered in ``plans.models``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import dashboard as db
from tractlens.operators import rules as R
from tractlens.operators import temporal as tm
from tractlens.oracle.sqlfn import clip_sql
from tractlens.oracle.views import APPLICATIONS, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.plans.temporal import FUTURE_SQL, TEMPORAL_SQL, TRENDS_SQL, YEARLY_SQL, _progression, temporal

_CONFIDENCE = clip_sql("(85 - years_ahead * 5 + coalesce(trend_strength, 0.5) * 10)", 60, 95)
_CTES = [APPLICATIONS, YEARLY_SQL, TEMPORAL_SQL, TRENDS_SQL, FUTURE_SQL, f"""
pred AS (SELECT census_tract, year, years_ahead, opportunity_score AS score, {_CONFIDENCE} AS conf FROM future)"""]
#: F16's limits, set to the scores of these tables' tracts.
PERFORMERS = {"min_avg": 45.0, "min_min": 44.0}


def forecast(spark, sf):
    p = _progression(spark, sf)
    confidence = tm.prediction_confidence(F.col("years_ahead"), F.coalesce(F.col("trend_strength"), F.lit(0.5)))
    return p.select("census_tract", "year", "years_ahead", F.col("opportunity_score").alias("predicted_opportunity_score"),
                    confidence.alias("prediction_confidence"))


@register("f13_year_summary_of_progression", rounded(with_ctes(*_CTES, body="""
SELECT year, count(*) AS count, avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score,
       count(*) FILTER (score >= 70) AS high_count, avg(conf) AS avg_confidence FROM pred GROUP BY year"""),
    ["avg_score", "min_score", "max_score", "avg_confidence"]))
def f13(spark, sf):
    return finalize(tm.prediction_year_summary(forecast(spark, sf)))


@register("f16_high_performers_of_progression", rounded(with_ctes(*_CTES, body=f"""
SELECT * FROM (SELECT census_tract, avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score, avg(conf) AS avg_confidence
               FROM pred GROUP BY 1) WHERE avg_score >= {PERFORMERS["min_avg"]} AND min_score >= {PERFORMERS["min_min"]}
ORDER BY avg_score DESC, census_tract LIMIT 15"""), ["avg_score", "min_score", "max_score", "avg_confidence"]))
def f16(spark, sf):
    return finalize(tm.consistent_high_performers(forecast(spark, sf), **PERFORMERS))


@register("i7_top_of_progression", rounded(with_ctes(*_CTES, body="""
SELECT census_tract, year, years_ahead, score AS predicted_opportunity_score, conf AS prediction_confidence, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, census_tract) AS rank FROM pred) WHERE rank <= 10"""),
    ["predicted_opportunity_score", "prediction_confidence"]))
def i7(spark, sf):
    return finalize(tm.top_per_year(forecast(spark, sf)))


@register("f17_levels_of_progression", with_ctes(*_CTES, body="""
SELECT years_ahead, count(*) FILTER (score >= 75) AS "High", count(*) FILTER (score >= 50 AND score < 75) AS "Medium",
       count(*) FILTER (score < 50) AS "Low" FROM pred GROUP BY 1"""))
def f17(spark, sf):
    p = forecast(spark, sf)
    return tm.level_pivot(p.withColumn("predicted_opportunity_level", tm.forecast_level(F.col("predicted_opportunity_score"))))


@register("i8_changes_of_progression", rounded(with_ctes(*_CTES, """
moved AS (SELECT census_tract, arg_max(score, years_ahead) - arg_min(score, years_ahead) AS forecast_change FROM pred GROUP BY 1)""", body="""
SELECT * FROM (SELECT *, 'top' AS direction FROM moved ORDER BY forecast_change DESC, census_tract LIMIT 5)
UNION ALL SELECT * FROM (SELECT *, 'bottom' FROM moved ORDER BY forecast_change, census_tract LIMIT 5)"""), ["forecast_change"]))
def i8(spark, sf):
    return finalize(tm.forecast_change_extremes(forecast(spark, sf)))


@register("h12_transition_of_progression", rounded(with_ctes(*_CTES, """
hist AS (SELECT census_tract, avg(d) AS t, arg_max(s, year) AS last_hist FROM (
  SELECT census_tract, year, opportunity_score AS s, opportunity_score - lag(opportunity_score) OVER (PARTITION BY census_tract ORDER BY year) AS d
  FROM temporal) GROUP BY 1)""", """
ahead AS (SELECT census_tract, arg_min(score, year) AS first_pred FROM pred GROUP BY 1)""", body="""
SELECT census_tract, coalesce(t, 0.0) AS historical_trend,
       CASE WHEN abs(coalesce(t, 0.0)) > 2 THEN 'significant' WHEN abs(coalesce(t, 0.0)) > 1 THEN 'moderate' ELSE 'stable' END AS historical_trend_class,
       first_pred - last_hist AS transition,
       CASE WHEN abs(first_pred - last_hist) > 5 THEN 'major' WHEN abs(first_pred - last_hist) > 2 THEN 'moderate' ELSE 'smooth' END AS transition_class
FROM hist JOIN ahead USING (census_tract)"""), ["historical_trend", "transition"]))
def h12(spark, sf):
    return finalize(tm.history_transition(temporal(spark, sf), forecast(spark, sf)))


_TIMELINE = """
timeline AS (SELECT census_tract, year, opportunity_score AS score, 'historical' AS data_type FROM temporal
             UNION ALL SELECT census_tract, year, score, 'predicted' FROM pred)"""


@register("j2_timeline_of_progression", rounded(with_ctes(*_CTES, _TIMELINE, body="SELECT * FROM timeline"), ["score"]))
def j2(spark, sf):
    return finalize(tm.historical_predicted_timeline(temporal(spark, sf), forecast(spark, sf)))


@register("f15_timeline_stats", rounded(with_ctes(*_CTES, _TIMELINE, body="""
SELECT year, data_type, avg(score) AS mean, stddev_samp(score) AS std, count(*) AS count FROM timeline GROUP BY 1, 2"""), ["mean", "std"]))
def f15(spark, sf):
    return finalize(db.timeline_stats(tm.historical_predicted_timeline(temporal(spark, sf), forecast(spark, sf))))


@register("h13_k19_confidence_bands", rounded(with_ctes(*_CTES, body=f"""
SELECT census_tract, year, {clip_sql("(score - 5.0 * (1 - conf / 100))", 0, 100)} AS low, {clip_sql("(score + 5.0 * (1 - conf / 100))", 0, 100)} AS high,
       {clip_sql("(score - 10.0)", 0, 100)} AS wide_low, {clip_sql("(score + 10.0)", 0, 100)} AS wide_high,
       CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS score_band,
       CASE WHEN conf >= 80 THEN 'High' WHEN conf >= 60 THEN 'Medium' ELSE 'Low' END AS confidence_level FROM pred"""),
    ["low", "high", "wide_low", "wide_high"]))
def h13(spark, sf):
    p = forecast(spark, sf)
    score, conf = F.col("predicted_opportunity_score"), F.col("prediction_confidence")
    low, high = tm.confidence_band(score, conf)
    wide_low, wide_high = tm.confidence_band(score)
    return finalize(p.select("census_tract", "year", low.alias("low"), high.alias("high"), wide_low.alias("wide_low"), wide_high.alias("wide_high"),
                             R.probability_band(score).alias("score_band"), R.confidence_band(conf).alias("confidence_level")))
