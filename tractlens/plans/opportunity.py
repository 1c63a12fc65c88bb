"""Tract opportunity job as registered queries."""

from __future__ import annotations

from tractlens.functions.stats import materialize_small
from tractlens.operators import opportunity as opp
from tractlens.oracle.tract_sql import (CENSUS_RATES, CLEAN, HPI_LATEST, MASTER, ROLLUP_V1, ROLLUP_V2,
                                        SCORED_DOUBLES, scored_cte)
from tractlens.oracle.views import APPLICATIONS, CENSUS, HPI, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.sources.tables import applications, census, hpi

SCORED_CTES = (APPLICATIONS, CENSUS, HPI, CLEAN, ROLLUP_V2, CENSUS_RATES, HPI_LATEST, MASTER, scored_cte())


def scored(spark, sf):
    # One row for each tract, written once: its ranges and its scores both read it.
    m = opp.master_dataset(applications(spark, sf), census(spark, sf), hpi(spark, sf))
    return opp.opportunity_score(materialize_small(m))


@register("f2_tract_rollup", rounded(with_ctes(APPLICATIONS, CLEAN, ROLLUP_V2, body="SELECT * FROM rollup_v2"),
          ["avg_loan_amount", "median_loan_amount", "avg_income", "median_income", "avg_dti", "avg_ltv",
           "approval_rate", "denial_rate"]))
def f2(spark, sf):
    return finalize(opp.tract_rollup_v2(applications(spark, sf)))


@register("f1_tract_rollup_pipeline", rounded(with_ctes(APPLICATIONS, CLEAN, ROLLUP_V1,
          body="SELECT * FROM rollup_v1"),
          ["avg_loan_amount", "median_loan_amount", "avg_income", "median_applicant_income",
           "avg_debt_to_income_ratio", "avg_loan_to_value_ratio", "approval_rate", "denial_rate"]))
def f1(spark, sf):
    return finalize(opp.tract_rollup_v1(applications(spark, sf)))


@register("c12_census_rates", rounded(with_ctes(CENSUS, CENSUS_RATES, body="SELECT * FROM census_r"),
          ["median_household_income", "unemployment_rate"]))
def c12(spark, sf):
    return finalize(opp.census_with_rates(census(spark, sf)))


@register("h6_latest_hpi", rounded(with_ctes(HPI, HPI_LATEST, body="SELECT * FROM hpi_latest"),
          ["hpi", "annual_change"]))
def h6(spark, sf):
    return finalize(opp.latest_per_tract(opp.hpi_with_change(hpi(spark, sf)), ["hpi", "annual_change"]))


@register("g1_g2_master_dataset", rounded(with_ctes(APPLICATIONS, CENSUS, HPI, CLEAN, ROLLUP_V2, CENSUS_RATES,
                                                   HPI_LATEST, MASTER, body="SELECT * FROM master"),
          [c for c in SCORED_DOUBLES if c not in ("market_accessibility", "risk_factors", "economic_indicators",
                                                   "lending_activity", "opportunity_score")]))
def g1(spark, sf):
    return finalize(opp.master_dataset(applications(spark, sf), census(spark, sf), hpi(spark, sf)))


@register("e6_opportunity_score", rounded(with_ctes(*SCORED_CTES, body="SELECT * FROM scored_final"),
          SCORED_DOUBLES))
def e6(spark, sf):
    return finalize(scored(spark, sf))


@register("e1_normalize_to_100", rounded(with_ctes(APPLICATIONS, CLEAN, ROLLUP_V2, body="""
SELECT census_tract, avg_loan_amount,
       CASE WHEN n = 0 OR mn = mx THEN 50.0
            ELSE CAST(100 AS DOUBLE) - (avg_loan_amount - mn) / (mx - mn) * CAST(100 AS DOUBLE) END AS loan_score
FROM rollup_v2 CROSS JOIN (SELECT min(avg_loan_amount) mn, max(avg_loan_amount) mx, count(avg_loan_amount) n
                           FROM rollup_v2)"""), ["avg_loan_amount", "loan_score"]))
def e1(spark, sf):
    r = opp.tract_rollup_v2(applications(spark, sf)).select("census_tract", "avg_loan_amount")
    return finalize(opp.normalize_to_100(r, "avg_loan_amount", higher_better=False, out="loan_score"))


@register("f8_scored_summary", rounded(with_ctes(*SCORED_CTES, body="""
SELECT count(*) AS total_census_tracts, avg(opportunity_score) AS average_opportunity_score,
       CAST(sum(total_population) AS BIGINT) AS total_population,
       count(*) FILTER (WHERE opportunity_level = 'High') / count(*) * CAST(100 AS DOUBLE) AS high_share_pct,
       count(*) FILTER (WHERE opportunity_level = 'High') AS high_count,
       count(*) FILTER (WHERE opportunity_level = 'Medium') AS medium_count,
       count(*) FILTER (WHERE opportunity_level = 'Low') AS low_count
FROM scored_final"""), ["average_opportunity_score", "high_share_pct"]))
def f8(spark, sf):
    return finalize(opp.scored_summary(scored(spark, sf)))


@register("i6_top_markets", rounded(with_ctes(*SCORED_CTES, body="""
SELECT census_tract, opportunity_score, opportunity_level, total_population, loan_count, approval_rate
FROM scored_final ORDER BY opportunity_score DESC, census_tract LIMIT 10"""),
          ["opportunity_score", "approval_rate"]))
def i6(spark, sf):
    return finalize(opp.top_markets(scored(spark, sf)))


@register("g4_key_overlap", with_ctes(APPLICATIONS, CENSUS, CLEAN, ROLLUP_V2, body="""
SELECT count(a.census_tract) AS left_keys, count(b.census_tract) AS right_keys,
       count(*) FILTER (WHERE a.census_tract IS NOT NULL AND b.census_tract IS NOT NULL) AS overlap_keys
FROM (SELECT DISTINCT census_tract FROM rollup_v2) a
FULL OUTER JOIN (SELECT DISTINCT census_tract FROM census) b ON a.census_tract = b.census_tract"""))
def g4(spark, sf):
    return opp.key_overlap(opp.tract_rollup_v2(applications(spark, sf)), census(spark, sf))


@register("c14_filter_tracts", rounded(with_ctes(*SCORED_CTES, body="""
SELECT count(*) AS tract_count, avg(opportunity_score) AS avg_score,
       CAST(sum(total_population) AS BIGINT) AS total_population
FROM scored_final WHERE opportunity_score BETWEEN 40 AND 100
  AND opportunity_level IN ('Medium', 'High') AND total_population BETWEEN 1000 AND 100000000"""),
          ["avg_score"]))
def c14(spark, sf):
    return finalize(opp.filter_tracts(scored(spark, sf), ["Medium", "High"], (40, 100), (1000, 100000000)))


_SEG_SQL = """
seg_base AS (
SELECT *, CASE WHEN unemployment_rate IS NULL AND denial_rate IS NULL THEN NULL
               ELSE (coalesce(unemployment_rate, 0) + coalesce(denial_rate * 100, 0))
                    / ((CASE WHEN unemployment_rate IS NULL THEN 0 ELSE 1 END)
                       + (CASE WHEN denial_rate IS NULL THEN 0 ELSE 1 END)) END AS business_risk_score
FROM scored_final),
seg_q AS (
SELECT quantile_cont(median_household_income, [0.33, 0.67]) AS iq,
       quantile_cont(business_risk_score, [0.33, 0.67]) AS rq FROM seg_base),
segmented AS (
SELECT b.*, concat_ws(', ',
         CASE WHEN median_household_income >= iq[2] THEN 'High Income'
              WHEN median_household_income >= iq[1] THEN 'Medium Income' ELSE 'Lower Income' END,
         CASE WHEN business_risk_score <= rq[1] THEN 'Low Risk'
              WHEN business_risk_score <= rq[2] THEN 'Medium Risk' ELSE 'High Risk' END) AS business_segment
FROM seg_base b CROSS JOIN seg_q)"""


@register("k3_business_segments", rounded(with_ctes(*SCORED_CTES, _SEG_SQL, body="""
SELECT census_tract, business_risk_score, business_segment FROM segmented"""), ["business_risk_score"]))
def k3(spark, sf):
    return finalize(opp.business_segments(scored(spark, sf))
                    .select("census_tract", "business_risk_score", "business_segment"))


@register("f12_business_segment_stats", rounded(with_ctes(*SCORED_CTES, _SEG_SQL, body="""
SELECT business_segment, avg(opportunity_score) AS avg_score, stddev_samp(opportunity_score) AS std_score,
       min(opportunity_score) AS min_score, max(opportunity_score) AS max_score, count(*) AS tract_count,
       CAST(sum(total_population) AS BIGINT) AS total_population,
       CASE WHEN contains(business_segment, 'High Income, Low Risk') THEN '🎯 Prime Target - Aggressive Expansion'
            WHEN contains(business_segment, 'High Income') AND contains(business_segment, 'Medium Risk')
                 THEN '📈 Growth Focus - Selective Expansion'
            WHEN contains(business_segment, 'Medium Income, Low Risk') THEN '🏦 Core Market - Steady Growth'
            WHEN contains(business_segment, 'Low Risk') THEN '✅ Stable Market - Maintain Presence'
            WHEN contains(business_segment, 'High Risk') THEN '⚠️ Caution - Limited Exposure'
            ELSE '📊 Standard Market - Balanced Approach' END AS strategy
FROM segmented GROUP BY business_segment"""), ["avg_score", "std_score", "min_score", "max_score"]))
def f12(spark, sf):
    return finalize(opp.business_segment_stats(opp.business_segments(scored(spark, sf))))

