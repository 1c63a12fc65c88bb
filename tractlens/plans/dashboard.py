"""Dashboard, insight and market-structure queries (SURVEY F4-F7, F9, F14,
F21-F26, F29, G6, H7, H11, I4, I5, J4, K10, 2.Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import dashboard as db
from tractlens.operators import opportunity as opp
from tractlens.operators import temporal as tm
from tractlens.operators import yoy
from tractlens.oracle.tract_sql import CLEAN, ROLLUP_V2
from tractlens.oracle.views import (APPLICATIONS, CENSUS, FIRST_LAST, HPI, TRACT_YEAR, YOY_CHANGES, rounded,
                                    with_ctes)
from tractlens.plans.opportunity import SCORED_CTES, _SEG_SQL, scored
from tractlens.plans.registry import finalize, register
from tractlens.plans.temporal import YEARLY_SQL, TEMPORAL_SQL, temporal
from tractlens.plans.validation import MODEL_INPUT_SQL, model_input
from tractlens.plans.yoy import EMERGING, metrics
from tractlens.sources.tables import applications, census, hpi, lenders


@register("f9_outcome_summary", rounded(with_ctes(APPLICATIONS, body="""
SELECT total_records, valid_records, approved, denied, valid_records - approved - denied AS other,
       approved / valid_records * 100 AS approval_rate, denied / valid_records * 100 AS denial_rate
FROM (SELECT count(*) AS total_records, count(*) FILTER (WHERE action_taken BETWEEN 1 AND 8) AS valid_records,
             count(*) FILTER (WHERE action_taken IN (1, 2, 6, 8)) AS approved,
             count(*) FILTER (WHERE action_taken IN (3, 7)) AS denied FROM applications)"""),
          ["approval_rate", "denial_rate"]))
def f9(spark, sf):
    return finalize(db.outcome_summary(applications(spark, sf)))


@register("f9_action_counts", with_ctes(APPLICATIONS, body="""
SELECT action_taken, count(*) AS count, action_taken IS NULL AS is_total
FROM applications GROUP BY ROLLUP (action_taken)"""))
def f9b(spark, sf):
    return db.action_counts(applications(spark, sf))


SEG_YEAR_SQL = """
seg_year AS (
SELECT market_segment, year, CAST(sum(total_applications) AS BIGINT) AS total_applications,
       round(avg(approval_rate), 2) AS approval_rate, round(avg(avg_loan_amount), 2) AS avg_loan_amount,
       round(sum(total_loan_volume), 2) AS total_loan_volume
FROM tract_year GROUP BY market_segment, year)"""


@register("f26_segment_year", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, SEG_YEAR_SQL, body="SELECT * FROM seg_year"),
                                      ["approval_rate", "avg_loan_amount", "total_loan_volume"]))
def f26(spark, sf):
    return finalize(yoy.segment_year(metrics(spark, sf)))


SEG_TREND_SQL = """
steps AS (
SELECT market_segment,
       (total_applications - lag(total_applications) OVER w) / lag(total_applications) OVER w AS pc,
       approval_rate - lag(approval_rate) OVER w AS d
FROM seg_year WINDOW w AS (PARTITION BY market_segment ORDER BY year)),
trend AS (SELECT market_segment, count(*) AS n_years, avg(pc) * 100 AS v_trend, avg(d) AS a_trend FROM steps GROUP BY 1),
tiers AS (SELECT market_segment, performance_tier, count(*) AS c FROM tract_year GROUP BY 1, 2),
info AS (SELECT market_segment, (SELECT count(DISTINCT census_tract) FROM tract_year t2
                                 WHERE t2.market_segment = t.market_segment) AS tract_count,
                arg_min(performance_tier, (-c, performance_tier)) AS avg_performance_tier
         FROM tiers t GROUP BY market_segment),
seg_trends AS (
SELECT t.market_segment,
       CASE WHEN n_years > 1 THEN coalesce(v_trend, 0.0) ELSE 0.0 END AS volume_trend_pct,
       CASE WHEN n_years > 1 THEN coalesce(a_trend, 0.0) ELSE 0.0 END AS approval_rate_trend,
       i.tract_count, i.avg_performance_tier
FROM trend t JOIN info i ON t.market_segment = i.market_segment)"""


@register("f4_segment_trends", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, SEG_YEAR_SQL, SEG_TREND_SQL,
                                                 body="SELECT * FROM seg_trends"),
                                       ["volume_trend_pct", "approval_rate_trend"]))
def f4(spark, sf):
    return finalize(yoy.segment_trends(metrics(spark, sf)))


_MARKET_YEAR_SQL = """
market_year AS (
SELECT year, CAST(sum(total_applications) AS BIGINT) AS total_applications,
       CAST(sum(total_originations) AS BIGINT) AS total_originations,
       round(avg(approval_rate), 2) AS approval_rate, round(avg(avg_loan_amount), 2) AS avg_loan_amount,
       round(avg(avg_income), 2) AS avg_income, round(avg(avg_dti), 2) AS avg_dti,
       round(sum(total_loan_volume), 2) AS total_loan_volume
FROM tract_year GROUP BY year)"""


MARKET_TREND_SQL = ("""
mst AS (
SELECT year,
""" + ",\n".join(f"       ({m} - lag({m}) OVER w) / lag({m}) OVER w AS {m}" for m in yoy.VOLUME_METRICS) + ",\n"
    + ",\n".join(f"       {m} - lag({m}) OVER w AS {m}" for m in yoy.RATE_METRICS) + """
FROM market_year WINDOW w AS (ORDER BY year)),
market_trends AS (SELECT CAST(count(*) AS BIGINT) AS total_years, """
    + ", ".join(f"CASE WHEN count(*) > 1 THEN coalesce(avg({m}) * 100, 0.0) ELSE 0.0 END AS {m}_trend"
                for m in yoy.VOLUME_METRICS) + ", "
    + ", ".join(f"CASE WHEN count(*) > 1 THEN coalesce(avg({m}), 0.0) ELSE 0.0 END AS {m}_trend"
                for m in yoy.RATE_METRICS) + " FROM mst)")


@register("f5_market_trends", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, _MARKET_YEAR_SQL, MARKET_TREND_SQL,
                                                body="SELECT * FROM market_trends"),
                                      [f"{m}_trend" for m in yoy.VOLUME_METRICS + yoy.RATE_METRICS]))
def f5(spark, sf):
    return finalize(yoy.market_trends(metrics(spark, sf)))


@register("f6_summary_stats", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, body="""
SELECT count(DISTINCT census_tract) AS total_census_tracts, min(year) AS first_year, max(year) AS last_year,
       count(DISTINCT year) AS years_analyzed, CAST(sum(total_applications) AS BIGINT) AS total_applications_all_years,
       avg(approval_rate) AS avg_approval_rate_all_years FROM tract_year"""), ["avg_approval_rate_all_years"]))
def f6(spark, sf):
    return finalize(yoy.summary_stats(metrics(spark, sf)))


@register("f6_segment_distribution", with_ctes(APPLICATIONS, TRACT_YEAR, body="""
SELECT market_segment AS value, count(*) AS count FROM tract_year GROUP BY 1"""))
def f6b(spark, sf):
    return yoy.distribution(metrics(spark, sf), "market_segment")


@register("f7_executive_summary", with_ctes(APPLICATIONS, TRACT_YEAR, _MARKET_YEAR_SQL, MARKET_TREND_SQL, body="""
SELECT min(year) || '-' || max(year) AS analysis_period, count(DISTINCT census_tract) AS total_tracts_analyzed,
       CAST(sum(total_applications) AS BIGINT) AS total_loan_applications,
       floor(avg(approval_rate) * 10.0 + 0.5) / 10.0 AS overall_approval_rate,
       (SELECT floor(total_applications_trend * 10.0 + 0.5) / 10.0 FROM market_trends) AS volume_trend,
       (SELECT floor(approval_rate_trend * 100.0 + 0.5) / 100.0 FROM market_trends) AS approval_rate_trend,
       (SELECT arg_min(market_segment, (-n, market_segment)) FROM (
          SELECT market_segment, count(*) AS n FROM tract_year GROUP BY 1)) AS dominant_market_segment
FROM tract_year"""))
def f7(spark, sf):
    return yoy.executive_summary(metrics(spark, sf))


def _one_decimal(x: str) -> str:
    t = f"CAST(floor(({x}) * 10 + 0.5) AS BIGINT)"
    return f"(CASE WHEN {t} < 0 THEN '-' ELSE '' END || (abs({t}) // 10) || '.' || (abs({t}) % 10) || '%')"


_FL_TEXTS = f"""census_tract, {_one_decimal("volume_growth_pct")} AS volume_growth,
       {_one_decimal("current_approval_rate")} AS approval_rate, market_segment"""


@register("i4_growth_opportunities", with_ctes(APPLICATIONS, TRACT_YEAR, FIRST_LAST, f"""
leaders AS (SELECT * FROM first_last WHERE volume_growth_pct > 20 AND approval_improvement > 5
            ORDER BY volume_growth_pct DESC, census_tract LIMIT 5)""", f"""
rising AS (SELECT * FROM first_last WHERE current_volume BETWEEN {EMERGING["lo"]} AND {EMERGING["hi"]}
             AND current_approval_rate >= {EMERGING["min_rate"]} AND volume_growth_pct > 0
           ORDER BY volume_growth_pct DESC, census_tract LIMIT 3)""", body=f"""
SELECT 'High Growth Leader' AS type, {_FL_TEXTS}, 'High' AS opportunity_score FROM leaders
UNION ALL SELECT 'Emerging Market', {_FL_TEXTS}, 'Moderate' FROM rising"""))
def i4(spark, sf):
    return yoy.growth_opportunities(metrics(spark, sf), **EMERGING)


@register("i5_risk_alerts", with_ctes(APPLICATIONS, TRACT_YEAR, YOY_CHANGES, """
latest AS (
SELECT *, volume_change_pct * 0.4 + approval_rate_change * 0.6 AS score
FROM yoy_changes WHERE to_year = (SELECT max(to_year) FROM yoy_changes)),
worst AS (SELECT *, row_number() OVER (ORDER BY score, census_tract) AS n FROM latest WHERE score IS NOT NULL)""", body=f"""
SELECT 'Declining Performance' AS type, census_tract, CAST(n AS INT) AS rank,
       {_one_decimal("volume_change_pct")} AS volume_change, {_one_decimal("approval_rate_change")} AS approval_rate_change,
       {_one_decimal("current_approval_rate")} AS current_approval_rate, market_segment,
       CASE WHEN approval_rate_change < -10 THEN 'High' ELSE 'Moderate' END AS risk_level
FROM worst WHERE n <= 5"""))
def i5(spark, sf):
    return yoy.risk_alerts(yoy.yoy_changes(metrics(spark, sf)))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_GROWTH_CTES = [f"""
leaders AS (SELECT * FROM first_last WHERE volume_growth_pct > 20 AND approval_improvement > 5
            ORDER BY volume_growth_pct DESC, census_tract LIMIT 5)""", f"""
rising AS (SELECT * FROM first_last WHERE current_volume BETWEEN {EMERGING["lo"]} AND {EMERGING["hi"]}
             AND current_approval_rate >= {EMERGING["min_rate"]} AND volume_growth_pct > 0
           ORDER BY volume_growth_pct DESC, census_tract LIMIT 3)"""]
_WORST_CTES = ["""
latest AS (
SELECT *, volume_change_pct * 0.4 + approval_rate_change * 0.6 AS score
FROM yoy_changes WHERE to_year = (SELECT max(to_year) FROM yoy_changes)),
worst AS (SELECT *, row_number() OVER (ORDER BY score, census_tract) AS n FROM latest WHERE score IS NOT NULL)"""]


@register("f27_insight_splits", with_ctes(
    APPLICATIONS, TRACT_YEAR, YOY_CHANGES, FIRST_LAST, SEG_YEAR_SQL, SEG_TREND_SQL, *_GROWTH_CTES, *_WORST_CTES, body=f"""
SELECT 'opportunity' AS section, split, census_tract AS key, market_segment, volume_growth AS volume, approval_rate AS approval,
       CAST(NULL AS VARCHAR) AS detail
FROM (SELECT 'High Growth Leader' AS split, {_FL_TEXTS} FROM leaders UNION ALL SELECT 'Emerging Market', {_FL_TEXTS} FROM rising)
UNION ALL
SELECT 'risk', CASE WHEN approval_rate_change < -10 THEN 'High' ELSE 'Moderate' END, census_tract, market_segment,
       {_one_decimal("volume_change_pct")}, {_one_decimal("approval_rate_change")}, {_one_decimal("current_approval_rate")}
FROM worst WHERE n <= 5
UNION ALL
SELECT 'trend', avg_performance_tier, market_segment, market_segment, {_one_decimal("volume_trend_pct")}, {_one_decimal("approval_rate_trend")},
       CAST(tract_count AS VARCHAR) FROM seg_trends"""))
def f27(spark, sf):
    m = metrics(spark, sf)
    return yoy.insight_splits(yoy.growth_opportunities(m, **EMERGING), yoy.risk_alerts(yoy.yoy_changes(m)), yoy.segment_trends(m))


@register("k10_strategic_recommendations", with_ctes(
    APPLICATIONS, TRACT_YEAR, SEG_YEAR_SQL, SEG_TREND_SQL, _MARKET_YEAR_SQL, MARKET_TREND_SQL, FIRST_LAST, """
leaders AS (SELECT count(*) AS n FROM (SELECT 1 FROM first_last WHERE volume_growth_pct > 20 AND approval_improvement > 5
                                       LIMIT 10))""", f"""
recs AS (
SELECT 1 AS o, CASE WHEN total_applications_trend > 10 THEN {_text(yoy.REC_GROWTH)}
                    WHEN total_applications_trend < -10 THEN {_text(yoy.REC_DECLINE)} END AS r FROM market_trends
UNION ALL SELECT 2, CASE WHEN approval_rate_trend < -2 THEN {_text(yoy.REC_APPROVAL_DOWN)}
                         WHEN approval_rate_trend > 2 THEN {_text(yoy.REC_APPROVAL_UP)} END FROM market_trends
UNION ALL SELECT 3, CASE WHEN max(volume_trend_pct) > 15 THEN {_text(yoy.REC_LUXURY)} END
          FROM seg_trends WHERE market_segment = 'Luxury'
UNION ALL SELECT 4, CASE WHEN min(approval_rate_trend) < -5 THEN {_text(yoy.REC_AFFORDABLE)} END
          FROM seg_trends WHERE market_segment = 'Affordable'
UNION ALL SELECT 5, CASE WHEN n > 5 THEN replace({_text(yoy.REC_LEADERS)}, '{{n}}', CAST(n AS VARCHAR)) END FROM leaders)""",
    body="""
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS position, r AS recommendation FROM recs WHERE r IS NOT NULL"""))
def k10(spark, sf):
    return yoy.strategic_recommendations(metrics(spark, sf))


@register("f14_yoy_export", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, body="""
SELECT year, market_segment, CAST(sum(total_applications) AS BIGINT) AS total_applications,
       round(avg(approval_rate), 2) AS avg_approval_rate, round(avg(avg_loan_amount), 2) AS avg_loan_amount
FROM tract_year GROUP BY 1, 2"""), ["avg_approval_rate", "avg_loan_amount"]))
def f14(spark, sf):
    return finalize(db.yoy_export(metrics(spark, sf)))


_CURVE_SQL = " UNION ALL ".join(f"""
SELECT CAST(floor({c} / {w}) AS BIGINT) AS bin, count(*) AS count,
       avg(CASE WHEN action_taken = 1 THEN 1.0 ELSE 0.0 END) * 100 AS approval_rate,
       floor({c} / {w}) * {w} + {w / 2} AS bin_center, '{c}' AS feature
FROM model_input WHERE {c} IS NOT NULL GROUP BY 1, 4""" for c, w in db.CURVE_BINS.items())


@register("f21_approval_curves", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body=_CURVE_SQL),
                                         ["approval_rate", "bin_center"]))
def f21(spark, sf):
    return finalize(db.approval_curves(model_input(spark, sf), db.CURVE_BINS))


_CORR_COLS = ["income", "loan_amount", "property_value", "credit_score", "debt_to_income_ratio"]


@register("f22_correlation_matrix", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr FROM model_input"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:])), ["corr"]))
def f22(spark, sf):
    return finalize(db.correlation_matrix(model_input(spark, sf), _CORR_COLS))


@register("f23_describe", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM model_input""" for c in _CORR_COLS)),
    ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def f23(spark, sf):
    return finalize(db.describe(model_input(spark, sf), _CORR_COLS))


@register("f24_histogram", rounded(with_ctes(*SCORED_CTES, """
b AS (SELECT min(opportunity_score) AS lo, max(opportunity_score) AS hi FROM scored_final)""", """
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((opportunity_score - lo) / ((hi - lo) / 20)), 19) END AS INT) AS bin,
             count(*) AS n FROM scored_final, b WHERE opportunity_score IS NOT NULL GROUP BY 1)""", body="""
SELECT CAST(r.bin AS INT) AS bin, coalesce(h.n, 0) AS count, lo + (hi - lo) / 20 * r.bin AS bin_start
FROM b, (SELECT unnest(range(0, 20)) AS bin) r LEFT JOIN h ON h.bin = r.bin"""), ["bin_start"]))
def f24(spark, sf):
    return finalize(db.histogram(scored(spark, sf), "opportunity_score"))


@register("f25_tract_history", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, body="""
SELECT census_tract, year, total_applications, approval_rate, avg_loan_amount,
       total_applications - lag(total_applications) OVER w AS total_applications_delta,
       approval_rate - lag(approval_rate) OVER w AS approval_rate_delta,
       avg_loan_amount - lag(avg_loan_amount) OVER w AS avg_loan_amount_delta
FROM tract_year WINDOW w AS (PARTITION BY census_tract ORDER BY year)"""),
    ["approval_rate", "avg_loan_amount", "approval_rate_delta", "avg_loan_amount_delta"]))
def f25(spark, sf):
    return finalize(db.tract_history(metrics(spark, sf)))


@register("h7_last_non_null", rounded(with_ctes(HPI, """
hc AS (SELECT *, (hpi - lag(hpi) OVER (PARTITION BY census_tract ORDER BY year))
                 / lag(hpi) OVER (PARTITION BY census_tract ORDER BY year) * 100 AS annual_change FROM hpi)""", body="""
SELECT census_tract, arg_max(hpi, year) FILTER (WHERE hpi IS NOT NULL) AS hpi,
       arg_max(annual_change, year) FILTER (WHERE annual_change IS NOT NULL) AS annual_change
FROM hc GROUP BY census_tract"""), ["hpi", "annual_change"]))
def h7(spark, sf):
    return finalize(db.last_non_null(opp.hpi_with_change(hpi(spark, sf)), ["hpi", "annual_change"]))


@register("g6_top_market_history", rounded(with_ctes(*SCORED_CTES, TRACT_YEAR.replace("tym_base AS (", "tym_base AS (", 1), """
top AS (SELECT census_tract FROM scored_final ORDER BY opportunity_score DESC, census_tract LIMIT 10)""", body="""
SELECT * FROM tract_year WHERE census_tract IN (SELECT census_tract FROM top)"""),
    ["approval_rate", "denial_rate", "withdrawal_rate", "avg_loan_amount", "median_loan_amount", "total_loan_volume",
     "avg_income", "median_income", "avg_dti", "median_dti", "avg_interest_rate", "median_interest_rate",
     "avg_property_value", "median_property_value", "conventional_pct", "fha_pct", "va_pct"]))
def g6(spark, sf):
    return finalize(db.semi_filter(metrics(spark, sf), opp.top_markets(scored(spark, sf))))


_J4_KEYS = """
last_year AS (SELECT DISTINCT census_tract FROM applications
              WHERE action_taken = 7 AND activity_year = (SELECT max(activity_year) FROM applications))"""


@register("j4_key_difference", with_ctes(APPLICATIONS, CENSUS, _J4_KEYS, body="""
SELECT census_tract, 'left_only' AS side FROM (SELECT census_tract FROM census EXCEPT SELECT census_tract FROM last_year)
UNION ALL
SELECT census_tract, 'right_only' FROM (SELECT census_tract FROM last_year EXCEPT SELECT census_tract FROM census)"""))
def j4(spark, sf):
    """Census tracts against those with a preapproval denial in the last year."""
    a = applications(spark, sf)
    last = a.agg(F.max("activity_year").alias("_last"))
    recent = a.crossJoin(F.broadcast(last)).filter((F.col("activity_year") == F.col("_last")) & (F.col("action_taken") == 7))
    return db.key_difference(census(spark, sf), recent)


@register("h11_trend_by_yoy_mean", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, TEMPORAL_SQL, body="""
SELECT census_tract, year, m AS avg_yoy_change_all,
       CASE WHEN m > 0.05 THEN 'improving' WHEN m < -0.05 THEN 'declining' ELSE 'stable' END AS trend_direction
FROM (SELECT census_tract, year, (""" + " + ".join(f"{c}_yoy_change" for c in tm.TEMPORAL_FEATURES)
    + f") / {len(tm.TEMPORAL_FEATURES)} AS m FROM temporal)"""), ["avg_yoy_change_all"]))
def h11(spark, sf):
    t = temporal(spark, sf).select("census_tract", "year", *[f"{c}_yoy_change" for c in tm.TEMPORAL_FEATURES])
    return finalize(tm.trend_by_yoy_mean(t).select("census_tract", "year", "avg_yoy_change_all", "trend_direction"))


LENDERS_SQL = """
lenders AS (SELECT l.l_orderkey AS application_id, l.lender_key, s.s_name AS lender_name
            FROM (SELECT l_orderkey, min(l_suppkey) AS lender_key FROM lineitem GROUP BY 1) l
            JOIN supplier s ON l.lender_key = s.s_suppkey)"""


@register("q_lender_concentration", rounded(with_ctes(APPLICATIONS, LENDERS_SQL, """
per AS (SELECT a.census_tract, l.lender_key, count(*) AS n FROM applications a JOIN lenders l
        ON a.application_id = l.application_id GROUP BY 1, 2),
tot AS (SELECT census_tract, sum(n) AS t FROM per GROUP BY 1)""", body="""
SELECT p.census_tract, count(*) AS lender_count, sum((n / t * 100) * (n / t * 100)) AS hhi,
       max(n / t * 100) AS top_lender_share, CAST(any_value(t) AS BIGINT) AS applications
FROM per p JOIN tot USING (census_tract) GROUP BY p.census_tract"""), ["hhi", "top_lender_share"]))
def q_hhi(spark, sf):
    return finalize(db.lender_concentration(applications(spark, sf), lenders(spark, sf))
                    .withColumn("applications", F.col("applications").cast("bigint")))


@register("q_purpose_shares", rounded(with_ctes(APPLICATIONS, body="""
SELECT census_tract, count(*) FILTER (WHERE loan_purpose IN (1)) / count(*) * 100 AS purchase_share,
       count(*) FILTER (WHERE loan_purpose IN (31, 32)) / count(*) * 100 AS refinance_share
FROM applications GROUP BY 1"""), ["purchase_share", "refinance_share"]))
def q_purpose(spark, sf):
    return finalize(db.purpose_shares(applications(spark, sf)))


@register("q_hpi_growth", rounded(with_ctes(HPI, """
g AS (SELECT census_tract, year, hpi,
             (hpi / lag(hpi, 1) OVER w - 1) * 100 AS growth_1y, (hpi / lag(hpi, 3) OVER w - 1) * 100 AS growth_3y
      FROM hpi WINDOW w AS (PARTITION BY census_tract ORDER BY year))""", body="""
SELECT g.*, v.hpi_volatility FROM g LEFT JOIN
  (SELECT census_tract, stddev_pop(growth_1y) AS hpi_volatility FROM g GROUP BY 1) v USING (census_tract)"""),
    ["hpi", "growth_1y", "growth_3y", "hpi_volatility"]))
def q_hpi(spark, sf):
    return finalize(db.hpi_growth(hpi(spark, sf)))


@register("f29_pipeline_summary", rounded(with_ctes(*SCORED_CTES, _SEG_SQL, body="""
SELECT (SELECT count(*) FROM scored_final) AS total_census_tracts, (SELECT avg(opportunity_score) FROM scored_final) AS average_opportunity_score,
       (SELECT CAST(sum(total_population) AS BIGINT) FROM scored_final) AS total_population,
       (SELECT count(*) FILTER (opportunity_level = 'High') FROM scored_final) AS high_tracts,
       (SELECT count(DISTINCT business_segment) FROM segmented) AS segments, count(*) AS records,
       avg(CAST(action_taken IN (1, 2, 6, 8) AS INT)) * 100 AS approval_rate FROM applications"""), ["average_opportunity_score", "approval_rate"]))
def f29(spark, sf):
    from tractlens.operators import segment as sg
    s = scored(spark, sf)
    prof = sg.segment_profiles(opp.business_segments(s), "business_segment")
    return finalize(db.pipeline_summary(s, prof, applications(spark, sf)))
