"""Temporal scoring and forecast-input jobs as registered queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tractlens.functions.stats import materialize_small
from tractlens.operators import opportunity as opp
from tractlens.operators import forecast as fc
from tractlens.operators import temporal as tm
from tractlens.oracle.sqlfn import clip_sql
from tractlens.oracle.views import APPLICATIONS, CENSUS, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.sources.tables import applications, census


def yearly(spark, sf):
    """The scores of each tract and year, written once for a query."""
    return materialize_small(tm.yearly_tract_scores(applications(spark, sf)))


YEARLY_SQL = """
ys_base AS (
SELECT census_tract, activity_year AS year, action_taken, loan_amount AS loan, income AS inc,
       CASE WHEN debt_to_income_ratio IS NULL OR debt_to_income_ratio = 'Exempt' THEN NULL
            WHEN contains(debt_to_income_ratio, '<20%') THEN 15.0
            WHEN contains(debt_to_income_ratio, '20%-<30%') THEN 25.0
            WHEN contains(debt_to_income_ratio, '30%-<36%') THEN 33.0
            WHEN contains(debt_to_income_ratio, '50%-60%') THEN 55.0
            WHEN contains(debt_to_income_ratio, '>60%') THEN 70.0 END AS dti
FROM applications WHERE census_tract IS NOT NULL),
ys_agg AS (
SELECT census_tract, year, count(*) AS total_applications, count(*) FILTER (WHERE action_taken = 1) AS orig,
       median(loan) AS ml, median(inc) AS mi, median(dti) AS md
FROM ys_base GROUP BY census_tract, year HAVING count(*) >= 5),
ys_comp AS (
SELECT *, least(100.0, total_applications / 50 * 100) AS la, orig / total_applications * 100 AS ar,
       CASE WHEN ml IS NULL THEN 100.0 ELSE least(100.0, ml / 500000 * 100) END AS ma,
       CASE WHEN mi IS NULL THEN 100.0 ELSE least(100.0, mi / 150 * 100) END AS ec,
       CASE WHEN md IS NULL THEN 50.0 ELSE greatest(0.0, 100.0 - md * 1.5) END AS rs
FROM ys_agg),
yearly AS (
SELECT census_tract, year, total_applications,
       floor((la * 0.3 + ar * 0.25 + ma * 0.2 + ec * 0.15 + rs * 0.1) * 100 + 0.5) / 100 AS opportunity_score,
       floor(la * 100 + 0.5) / 100 AS lending_activity, floor(ar * 100 + 0.5) / 100 AS approval_rate,
       floor(ma * 100 + 0.5) / 100 AS market_accessibility, floor(ec * 100 + 0.5) / 100 AS economic_indicators,
       floor(rs * 100 + 0.5) / 100 AS risk_factors, ml AS avg_loan_amount, mi AS avg_income,
       coalesce(md, 0.0) AS avg_dti
FROM ys_comp)"""
YEARLY_DOUBLES = ["opportunity_score", "lending_activity", "approval_rate", "market_accessibility",
                  "economic_indicators", "risk_factors", "avg_loan_amount", "avg_income", "avg_dti"]


@register("e9_yearly_tract_scores", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, body="SELECT * FROM yearly"),
                                            YEARLY_DOUBLES))
def e9(spark, sf):
    return finalize(tm.yearly_tract_scores(applications(spark, sf)).drop("_raw_score"))


def _banded(x: str, limits, default: str, op: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {x} {op} {lim} THEN {text}" for lim, text in limits) + f" ELSE {default} END"


def _half_up(x: str, digits: int) -> str:
    """printf rounds halves to even, the JVM's formatter up."""
    return f"printf('%.{digits}f', floor({x} * {10**digits} + 0.5) / {10**digits}.0)"


def _reasons_sql() -> str:
    n, ar, loan, inc, dti = "total_applications", _half_up("approval_rate", 1), "avg_loan_amount", _half_up("avg_income", 0), _half_up("avg_dti", 1)
    money = "'$' || format('{:,}', CAST(round_even(avg_loan_amount, 0) AS BIGINT))"
    act = _banded(n, [(50, f"'High lending activity with ' || {n} || ' applications (excellent market demand)'"),
                      (25, f"'Moderate lending activity with ' || {n} || ' applications (good market interest)'"),
                      (10, f"'Limited lending activity with ' || {n} || ' applications (emerging market)'")],
                  f"'Low lending activity with only ' || {n} || ' applications (underdeveloped market)'")
    appr = _banded("approval_rate", [(80, f"'Excellent approval rate of ' || {ar} || '% indicates strong creditworthiness'"),
                                     (60, f"'Good approval rate of ' || {ar} || '% shows moderate lending success'"),
                                     (40, f"'Fair approval rate of ' || {ar} || '% suggests some lending challenges'")],
                   f"'Low approval rate of ' || {ar} || '% indicates significant lending barriers'")
    acc = _banded(loan, [(400000, f"'High-value market with median loan of ' || {money} || ' (premium segment)'"),
                         (250000, f"'Mid-range market with median loan of ' || {money} || ' (mainstream segment)'"),
                         (150000, f"'Affordable market with median loan of ' || {money} || ' (entry-level segment)'")],
                  f"'Low-value market with median loan of ' || {money} || ' (budget segment)'")
    eco = _banded("avg_income", [(120, f"'High-income area with median income $' || {inc} || 'k (strong economic foundation)'"),
                                 (80, f"'Middle-income area with median income $' || {inc} || 'k (stable economic base)'"),
                                 (50, f"'Moderate-income area with median income $' || {inc} || 'k (developing economic base)'")],
                  f"'Low-income area with median income $' || {inc} || 'k (economic growth potential)'")
    risk = _banded("avg_dti", [(0, "'Risk assessment based on standard lending criteria (limited DTI data)'"),
                               (25, f"'Low risk profile with median DTI of ' || {dti} || '% (excellent financial health)'"),
                               (35, f"'Moderate risk profile with median DTI of ' || {dti} || '% (good financial stability)'"),
                               (50, f"'Higher risk profile with median DTI of ' || {dti} || '% (manageable debt levels)'")],
                   f"'High risk profile with median DTI of ' || {dti} || '% (elevated debt burden)'", "<=")
    assess = _banded("(la * 0.3 + ar * 0.25 + ma * 0.2 + ec * 0.15 + rs * 0.1)", [(k, f"'{t}'") for k, t in tm.ASSESSMENTS], f"'{tm.ASSESSMENT_DEFAULT}'")
    scored = YEARLY_SQL.replace("FROM ys_comp)", "FROM ys_comp)").replace("SELECT census_tract, year, total_applications,\n       floor(",
                                                                     "SELECT census_tract, year, total_applications, la, ar, ma, ec, rs,\n       floor(")
    return with_ctes(APPLICATIONS, scored, body=f"""
SELECT census_tract, year, opportunity_score AS overall_score, {assess} AS assessment, {act} AS lending_activity, {appr} AS approval_rate,
       {acc} AS market_accessibility, {eco} AS economic_indicators, {risk} AS risk_factors FROM yearly""")


@register("e8_score_reasoning", rounded(_reasons_sql(), ["overall_score"]))
def e8(spark, sf):
    parts = ("lending_activity", "approval_rate", "market_accessibility", "economic_indicators", "risk_factors")
    return finalize(tm.score_reasoning(yearly(spark, sf)).select(
        "census_tract", "year", "reasoning.overall_score", "reasoning.assessment",
        *[F.col(f"reasoning.components.{c}.reasoning").alias(c) for c in parts]))


@register("e8_score_reasoning_nested")
def e8_nested(spark, sf):
    return tm.score_reasoning(yearly(spark, sf)).select("census_tract", "year", "opportunity_score", "reasoning")


def _temporal_sql() -> str:
    cols = []
    for c in tm.TEMPORAL_FEATURES:
        prev = f"lag({c}) OVER w"
        cols += [f"{prev} AS {c}_lag1", f"{c} - {prev} AS {c}_yoy_change",
                 f"""CASE WHEN {prev} IS NULL THEN NULL
                          WHEN {prev} = 0 THEN (CASE WHEN {c} > 0 THEN 'inf'::DOUBLE WHEN {c} < 0 THEN '-inf'::DOUBLE END)
                          ELSE ({c} - {prev}) / {prev} END AS {c}_yoy_pct_change""",
                 f"avg({c}) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS {c}_ma2"]
    derived = [f"{c}_{s}" for c in tm.TEMPORAL_FEATURES for s in ("lag1", "yoy_change", "yoy_pct_change", "ma2")]
    fill = ", ".join(
        f"""CASE WHEN abs(coalesce(last_value({d} IGNORE NULLS) OVER (PARTITION BY census_tract ORDER BY year
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)) = 'inf'::DOUBLE THEN 0.0
            ELSE coalesce(last_value({d} IGNORE NULLS) OVER (PARTITION BY census_tract ORDER BY year
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) END AS {d}""" for d in derived)
    return f"""
tf_src AS (SELECT *, count(*) OVER (PARTITION BY census_tract) AS n_years FROM yearly),
tf_raw AS (
SELECT census_tract, year, total_applications, {', '.join(tm.TEMPORAL_FEATURES)}, avg_loan_amount, avg_income,
       avg_dti, (year - (SELECT min(year) FROM yearly)) / 2.0 AS year_normalized, {', '.join(cols)}
FROM tf_src WHERE n_years >= 2 WINDOW w AS (PARTITION BY census_tract ORDER BY year)),
temporal AS (
SELECT census_tract, year, total_applications, {', '.join(tm.TEMPORAL_FEATURES)}, avg_loan_amount, avg_income,
       avg_dti, year_normalized, {fill}
FROM tf_raw)"""


TEMPORAL_SQL = _temporal_sql()
TEMPORAL_DOUBLES = YEARLY_DOUBLES + ["year_normalized"] + [
    f"{c}_{s}" for c in tm.TEMPORAL_FEATURES for s in ("lag1", "yoy_change", "yoy_pct_change", "ma2")]


def temporal(spark, sf):
    return tm.temporal_features(yearly(spark, sf).drop("_raw_score"))


@register("h2_h5_temporal_features", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, TEMPORAL_SQL,
                                                      body="SELECT * FROM temporal"), TEMPORAL_DOUBLES))
def h2(spark, sf):
    return finalize(temporal(spark, sf))


TRENDS_SQL = """
tr_d AS (SELECT census_tract, opportunity_score - lag(opportunity_score) OVER (PARTITION BY census_tract ORDER BY year) AS d
         FROM temporal),
tr_g AS (SELECT census_tract, count(d) AS n, avg(d) AS avg_d, stddev_pop(d) AS sd,
                count(*) FILTER (WHERE d > 0) AS pos, count(*) FILTER (WHERE d < 0) AS neg
         FROM tr_d GROUP BY census_tract),
trends AS (
SELECT census_tract,
       CASE WHEN (CASE WHEN n > 0 THEN avg_d ELSE 0.0 END) > 2 THEN 'increasing'
            WHEN (CASE WHEN n > 0 THEN avg_d ELSE 0.0 END) < -2 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
       CASE WHEN n > 0 THEN avg_d ELSE 0.0 END AS avg_yoy_change,
       CASE WHEN n > 1 THEN greatest(pos, neg) / n ELSE 0.5 END AS trend_strength,
       CASE WHEN n > 1 THEN sd ELSE 0.0 END AS volatility
FROM tr_g)"""


@register("h9_tract_trends", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, TEMPORAL_SQL, TRENDS_SQL,
                                              body="SELECT * FROM trends"),
                                     ["avg_yoy_change", "trend_strength", "volatility"]))
def h9(spark, sf):
    return finalize(tm.tract_trends(temporal(spark, sf)))


def _progression_sql() -> str:
    """L9 for one and two years ahead: ``future`` holds every column of the panel."""
    prog, damp = f"coalesce(avg_yoy_change, 0.0) * h * pow({tm.DAMPING}, h)", f"pow({tm.DAMPING}, h)"
    new = {}
    for c in tm.PROGRESSION_FEATURES:
        b = f"coalesce({c}, 0.0)"
        if c in ("opportunity_score", "approval_rate"):
            new[c] = clip_sql(f"({b} + {prog}{' * 0.5' if c == 'approval_rate' else ''})", 0, 100)
        else:
            v = f"({b} + {prog} * 0.7)"
            new[c] = f"(CASE WHEN {v} < 0 THEN 0.0 WHEN {v} > m_{c} * 1.5 THEN m_{c} * 1.5 ELSE {v} END)"
    value = {c: f"n_{c}" if c in new else c for c in tm.TEMPORAL_FEATURES}
    shifted = [x for c in tm.TEMPORAL_FEATURES for x in (f"{value[c]} AS {c}_lag1", f"avg_yoy_change * {damp} AS {c}_yoy_change",
                                                         f"{c}_yoy_pct_change", f"{value[c]} AS {c}_ma2")]
    return f"""
future0 AS (
SELECT t.*, tr.avg_yoy_change, tr.trend_strength, h, recent, base, {", ".join(f"m_{c}" for c in tm.PROGRESSION_FEATURES)}
FROM temporal t LEFT JOIN trends tr ON tr.census_tract = t.census_tract, (VALUES (1), (2)) AS hz(h),
     (SELECT max(year) AS recent, min(year) AS base FROM temporal) AS ends,
     (SELECT {", ".join(f"max(coalesce({c}, 0.0)) AS m_{c}" for c in tm.PROGRESSION_FEATURES)} FROM temporal
      WHERE year = (SELECT max(year) FROM temporal)) AS maxes
WHERE t.year = recent),
future1 AS (SELECT *, {", ".join(f"{e} AS n_{c}" for c, e in new.items())} FROM future0),
future AS (
SELECT census_tract, CAST(recent + h AS INT) AS year, CAST(h AS INT) AS years_ahead, total_applications,
       {", ".join(f"n_{c} AS {c}" if c in new else c for c in tm.TEMPORAL_FEATURES)}, avg_loan_amount, avg_income, avg_dti,
       (recent + h - base) / CAST(4 AS DOUBLE) AS year_normalized, {", ".join(shifted)}, avg_yoy_change, trend_strength
FROM future1)"""


FUTURE_SQL = _progression_sql()


def _progression(spark, sf):
    t = materialize_small(temporal(spark, sf))
    recent = t.agg(F.max("year")).first()[0]
    return tm.temporal_progression(t, tm.tract_trends(t), [recent + 1, recent + 2])


@register("l9_temporal_progression", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, TEMPORAL_SQL, TRENDS_SQL, FUTURE_SQL, body="SELECT * FROM future"),
                                             [*TEMPORAL_DOUBLES, "avg_yoy_change", "trend_strength"]))
def l9(spark, sf):
    return finalize(_progression(spark, sf))


@register("l7_economic_projection", rounded(with_ctes(CENSUS, """
census_r AS (SELECT *, floor(unemployed / civilian_labor_force * 100.0 * 100 + 0.5) / 100 AS unemployment_rate FROM census)""",
    body="""
SELECT census_tract, years_ahead,
       median_household_income * pow(1 + (1.0 / (1.0 + years_ahead * 0.1)) * 0.025, years_ahead) AS median_household_income,
       total_population * pow(1 + (1.0 / (1.0 + years_ahead * 0.1)) * 0.008, years_ahead) AS total_population,
       CASE WHEN unemployment_rate * (1 + (1.0 / (1.0 + years_ahead * 0.1)) * -0.02) < 0 THEN 0.0
            WHEN unemployment_rate * (1 + (1.0 / (1.0 + years_ahead * 0.1)) * -0.02) > 25 THEN 25.0
            ELSE unemployment_rate * (1 + (1.0 / (1.0 + years_ahead * 0.1)) * -0.02) END AS unemployment_rate
FROM census_r, (VALUES (1), (2), (3), (5)) h(years_ahead)"""),
    ["median_household_income", "total_population", "unemployment_rate"]))
def l7(spark, sf):
    c = opp.census_with_rates(census(spark, sf)).select("census_tract", "median_household_income",
                                                         "total_population", "unemployment_rate")
    return finalize(tm.economic_projection(c).select(
        "census_tract", "years_ahead", "median_household_income",
        F.col("total_population").cast("double").alias("total_population"), "unemployment_rate"))


def _panel_sql() -> str:
    cols = []
    for c in fc.PANEL_FEATURES:
        cols += [f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for k in fc.LAGS]
        cols += [f"avg({c}) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS {c}_ma_{k}" for k in fc.AVERAGES]
        cols += [f"{c} - lag({c}) OVER w AS {c}_trend"]
    return f"""
panel_src AS (SELECT *, count(*) OVER (PARTITION BY census_tract) AS n_years, min(year) OVER (PARTITION BY census_tract) AS y0,
                     max(year) OVER (PARTITION BY census_tract) AS y1 FROM yearly),
panel AS (
SELECT census_tract, year, {', '.join(fc.PANEL_FEATURES)}, {', '.join(cols)},
       CASE WHEN y1 > y0 THEN (year - y0) / CAST(y1 - y0 AS DOUBLE) END AS year_position,
       sin(year * CAST({2 * math.pi / fc.CYCLE_YEARS!r} AS DOUBLE)) AS year_sin, cos(year * CAST({2 * math.pi / fc.CYCLE_YEARS!r} AS DOUBLE)) AS year_cos
FROM panel_src WHERE n_years >= 2 WINDOW w AS (PARTITION BY census_tract ORDER BY year))"""


PANEL_SQL = _panel_sql()
_PANEL_DOUBLES = [*fc.PANEL_FEATURES, *[f"{c}_lag_{k}" for c in fc.PANEL_FEATURES for k in fc.LAGS],
                  *[f"{c}_ma_{k}" for c in fc.PANEL_FEATURES for k in fc.AVERAGES],
                  *[f"{c}_trend" for c in fc.PANEL_FEATURES], "year_position", "year_sin", "year_cos"]
_INPUTS = ([f"{c}_lag_{k}" for c in fc.PANEL_FEATURES for k in fc.LAGS]
           + [f"{c}_ma_{k}" for c in fc.PANEL_FEATURES for k in fc.AVERAGES] + ["year_sin", "year_cos"])


def panel(spark, sf):
    return fc.forecast_panel(yearly(spark, sf).select("census_tract", "year", *fc.PANEL_FEATURES))


@register("h2_h5_forecast_panel", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, PANEL_SQL, body="SELECT * FROM panel"),
                                          _PANEL_DOUBLES))
def h2_panel(spark, sf):
    return finalize(panel(spark, sf))


@register("l6_forecast_inputs", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, PANEL_SQL, f"""
kept AS (SELECT * FROM panel WHERE {" + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in _INPUTS)} >= {fc.KEEP_SHARE * len(_INPUTS)})""", f"""
med AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _INPUTS)} FROM kept)""", body=f"""
SELECT census_tract, year, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _INPUTS)} FROM kept, med"""), _INPUTS))
def l6(spark, sf):
    return finalize(fc.forecast_inputs(panel(spark, sf)).select("census_tract", "year", *_INPUTS))


_FUTURE = [c for c in _INPUTS if not c.startswith("year_")] + ["total_population_trend", "unheard_of"]


@register("l8_future_rows", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, """
now AS (SELECT * FROM yearly WHERE year = (SELECT max(year) FROM yearly))""", f"""
mid AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in fc.PANEL_FEATURES)} FROM now)""", body="SELECT census_tract, " + ", ".join(
    f"coalesce({c.split('_lag_')[0].split('_ma_')[0]}, m_{c.split('_lag_')[0].split('_ma_')[0]}, 50.0) AS {c}"
    for c in _FUTURE[:-2]) + ", CAST(0 AS DOUBLE) AS total_population_trend, CAST(50 AS DOUBLE) AS unheard_of FROM now, mid"), _FUTURE))
def l8(spark, sf):
    y = yearly(spark, sf).select("census_tract", "year", *fc.PANEL_FEATURES)
    latest = y.crossJoin(F.broadcast(y.agg(F.max("year").alias("_latest")))).filter("year = _latest")
    return finalize(fc.future_rows(latest.select("census_tract", *fc.PANEL_FEATURES), _FUTURE).select("census_tract", *_FUTURE))


_LEVEL = "CASE WHEN opportunity_score >= 75 THEN 'High' WHEN opportunity_score >= 50 THEN 'Medium' ELSE 'Low' END"


@register("l10_l11_forecast_insights", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, TEMPORAL_SQL, TRENDS_SQL, FUTURE_SQL, """
moves AS (SELECT census_tract, max(opportunity_score) FILTER (years_ahead = 2) - max(opportunity_score) FILTER (years_ahead = 1) AS d
          FROM future GROUP BY 1)""", body=f"""
SELECT 'level_count' AS insight, years_ahead, {_LEVEL} AS key, CAST(count(*) AS DOUBLE) AS value FROM future GROUP BY 2, 3
UNION ALL SELECT 'score_mean', years_ahead, NULL, floor(avg(opportunity_score) * 100 + 0.5) / 100 FROM future GROUP BY 2
UNION ALL SELECT 'score_std', years_ahead, NULL, floor(stddev_samp(opportunity_score) * 100 + 0.5) / 100 FROM future GROUP BY 2
UNION ALL SELECT 'total_tracts', NULL, NULL, CAST(count(DISTINCT census_tract) AS DOUBLE) FROM future
UNION ALL SELECT * FROM (SELECT 'top_improving', CAST(NULL AS INT), census_tract, d FROM moves WHERE d IS NOT NULL ORDER BY d DESC, census_tract LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'top_declining', CAST(NULL AS INT), census_tract, d FROM moves WHERE d IS NOT NULL ORDER BY d, census_tract LIMIT 5)"""),
    ["value"]))
def l11(spark, sf):
    """Insight table over the damped progression of each tract's score (L9), with L10's second rule."""
    p = _progression(spark, sf).select("census_tract", "years_ahead", F.col("opportunity_score").alias("predicted_opportunity_score"))
    p = p.withColumn("predicted_opportunity_level", tm.forecast_level(F.col("predicted_opportunity_score")))
    return finalize(fc.forecast_insights(fc.with_confidence(p)))
