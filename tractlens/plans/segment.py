"""Market segmentation jobs as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import opportunity as opp
from tractlens.operators import segment as sg
from tractlens.oracle.views import rounded, with_ctes
from tractlens.plans.opportunity import SCORED_CTES, _SEG_SQL, scored
from tractlens.plans.registry import finalize, register


def segmented(spark, sf):
    return opp.business_segments(scored(spark, sf))


def profiles(spark, sf):
    return sg.segment_profiles(segmented(spark, sf), "business_segment")


_AVG = sg.DEMO_FEATURES + sg.LENDING_FEATURES + sg.OPPORTUNITY_FEATURES
PROFILE_SQL = f"""
prof0 AS (
SELECT business_segment, count(*) AS tract_count,
       {', '.join(f'avg({c}) AS avg_{c}' for c in _AVG)},
       {', '.join(f'median({c}) AS median_{c}' for c in sg.DEMO_FEATURES)}
FROM segmented GROUP BY business_segment),
prof1 AS (
SELECT *, tract_count / sum(tract_count) OVER () * 100 AS percentage_of_market,
       CASE WHEN (CAST(coalesce(avg_unemployment_rate > 5, FALSE) AS INT) + CAST(coalesce(avg_denial_rate > 0.15, FALSE) AS INT)
                  + CAST(coalesce(avg_median_household_income < 60000, FALSE) AS INT)) >= 2 THEN 'High'
            WHEN (CAST(coalesce(avg_unemployment_rate > 5, FALSE) AS INT) + CAST(coalesce(avg_denial_rate > 0.15, FALSE) AS INT)
                  + CAST(coalesce(avg_median_household_income < 60000, FALSE) AS INT)) = 1 THEN 'Moderate'
            ELSE 'Low' END AS risk_level,
       CASE WHEN (CAST(coalesce(avg_total_population > 3000, FALSE) AS INT) + CAST(coalesce(avg_loan_count > 20, FALSE) AS INT)
                  + CAST(coalesce(avg_median_household_income > 70000, FALSE) AS INT)
                  + CAST(coalesce(avg_opportunity_score > 70, FALSE) AS INT)) >= 3 THEN 'High'
            WHEN (CAST(coalesce(avg_total_population > 3000, FALSE) AS INT) + CAST(coalesce(avg_loan_count > 20, FALSE) AS INT)
                  + CAST(coalesce(avg_median_household_income > 70000, FALSE) AS INT)
                  + CAST(coalesce(avg_opportunity_score > 70, FALSE) AS INT)) >= 2 THEN 'Moderate'
            ELSE 'Low' END AS return_potential
FROM prof0),
profiles AS (
SELECT *, CASE {' '.join(f"WHEN risk_level = '{r}' AND return_potential = '{p}' THEN '{v}'" for (r, p), v in sg.PRIORITY.items())}
              ELSE 'Medium Priority' END AS strategic_priority
FROM prof1)"""
PROFILE_DOUBLES = [f"avg_{c}" for c in _AVG] + [f"median_{c}" for c in sg.DEMO_FEATURES] + ["percentage_of_market"]


@register("f10_segment_profiles", rounded(with_ctes(*SCORED_CTES, _SEG_SQL, PROFILE_SQL, body="SELECT * FROM profiles"),
                                          PROFILE_DOUBLES))
def f10(spark, sf):
    return finalize(profiles(spark, sf))


@register("e11_risk_return_matrix", rounded(with_ctes(*SCORED_CTES, _SEG_SQL, PROFILE_SQL, body="""
SELECT business_segment AS segment,
       least(coalesce(least(avg_unemployment_rate * 10, 50.0), 0.0) + coalesce(avg_denial_rate * 100, 0.0), 100.0) AS risk_score,
       coalesce(avg_opportunity_score, 50.0) AS return_score, tract_count, strategic_priority
FROM profiles"""), ["risk_score", "return_score"]))
def e11(spark, sf):
    return finalize(sg.risk_return_matrix(profiles(spark, sf)))


@register("f11_k9_competitive_analysis", rounded(with_ctes(*SCORED_CTES, _SEG_SQL, PROFILE_SQL, """
seg AS (SELECT business_segment, sum(loan_count) AS seg_loans, sum(avg_loan_amount) AS seg_value,
               avg(approval_rate) AS seg_approval FROM segmented GROUP BY business_segment),
seg2 AS (SELECT *, sum(seg_loans) OVER () AS tl, sum(seg_value) OVER () AS tv FROM seg),
j AS (SELECT s.*, p.tract_count, p.risk_level, p.return_potential, p.strategic_priority,
             (CASE WHEN p.tract_count > 5 THEN 2 WHEN p.tract_count > 2 THEN 1 ELSE 0 END
              + CASE WHEN p.return_potential = 'High' THEN 3 WHEN p.return_potential = 'Moderate' THEN 2 ELSE 1 END
              + CASE WHEN p.risk_level = 'Low' THEN 2 WHEN p.risk_level = 'Moderate' THEN 1 ELSE 0 END) AS pts
      FROM seg2 s JOIN profiles p ON s.business_segment = p.business_segment)""", body="""
SELECT business_segment,
       CASE WHEN tl > 0 THEN seg_loans / tl * 100 ELSE 0.0 END AS market_share_potential,
       CASE WHEN tv > 0 THEN seg_value / tv * 100 ELSE 0.0 END AS value_share_potential,
       CASE WHEN seg_approval > 0.8 THEN 'High' WHEN seg_approval > 0.6 THEN 'Moderate' ELSE 'Low' END AS competitive_intensity,
       CASE WHEN pts >= 6 THEN 'High' WHEN pts >= 4 THEN 'Moderate' ELSE 'Low' END AS market_attractiveness,
       CASE WHEN strategic_priority = 'High Priority' THEN 'Aggressive Market Entry'
            WHEN strategic_priority = 'Medium Priority' AND risk_level = 'Low' THEN 'Selective Market Entry'
            WHEN strategic_priority = 'Medium Priority' THEN 'Partnership Strategy'
            WHEN strategic_priority = 'Low Priority' THEN 'Monitor and Evaluate' ELSE 'Avoid Market' END AS recommended_strategy
FROM j"""), ["market_share_potential", "value_share_potential"]))
def f11(spark, sf):
    seg = segmented(spark, sf)
    return finalize(sg.competitive_analysis(seg, sg.segment_profiles(seg, "business_segment"), "business_segment"))


def _texts(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_INC = "avg_median_household_income"


@register("k7_k8_product_recommendations", with_ctes(*SCORED_CTES, _SEG_SQL, PROFILE_SQL, f"""
lists AS (
SELECT business_segment,
       list_concat(list_concat(
         CASE WHEN {_INC} > {sg.PRODUCTS_BY_INCOME[0][0]} THEN {_texts(sg.PRODUCTS_BY_INCOME[0][1])}
              WHEN {_INC} > {sg.PRODUCTS_BY_INCOME[1][0]} THEN {_texts(sg.PRODUCTS_BY_INCOME[1][1])} ELSE {_texts(sg.PRODUCTS_LOW_INCOME)} END,
         CASE WHEN risk_level = 'Low' THEN {_texts(sg.PRODUCTS_BY_RISK["Low"])} WHEN risk_level = 'Moderate' THEN {_texts(sg.PRODUCTS_BY_RISK["Moderate"])}
              ELSE {_texts(sg.PRODUCTS_HIGH_RISK)} END),
         [CASE WHEN tract_count > 5 THEN 'Branch/Office Expansion' ELSE 'Digital/Mobile Services' END]) AS products,
       CASE WHEN {_INC} > 70000 THEN {_texts(sg.CHANNELS_HIGH_INCOME)} ELSE {_texts(sg.CHANNELS_OTHER)} END AS channels,
       CASE WHEN risk_level = 'Low' AND coalesce(avg_approval_rate, 0) > 0.8 THEN 'Competitive Pricing'
            WHEN risk_level = 'Moderate' THEN 'Standard Pricing' ELSE 'Risk-Adjusted Pricing' END AS pricing_strategy
FROM profiles)""", body="""
SELECT business_segment AS segment, array_to_string(products[1:3], ' | ') AS primary_products, array_to_string(products[4:], ' | ') AS secondary_products,
       array_to_string(channels, ' | ') AS marketing_channels, pricing_strategy FROM lists"""))
def k7(spark, sf):
    lists = ("primary_products", "secondary_products", "marketing_channels")
    r = sg.product_recommendations(profiles(spark, sf))
    return r.withColumns({c: F.array_join(c, " | ") for c in lists})


@register("f28_segment_overview", with_ctes(*SCORED_CTES, _SEG_SQL, body="""
SELECT count(*) AS segment_count, arg_min(business_segment, (-n, business_segment)) AS largest_segment,
       max(n) AS largest_segment_size, count(*) FILTER (WHERE mx >= 70) AS segments_with_high_score
FROM (SELECT business_segment, count(*) AS n, max(opportunity_score) AS mx FROM segmented GROUP BY 1)"""))
def f28(spark, sf):
    return sg.segment_overview(segmented(spark, sf))


@register("l2_kmeans_segments")
def l2(spark, sf):
    seg, _ = sg.kmeans_segments(scored(spark, sf))
    return seg.select("census_tract", "market_segment", "segment_name", "opportunity_score")


@register("l2_kmeans_profiles")
def l2p(spark, sf):
    seg, _ = sg.kmeans_segments(scored(spark, sf))
    return sg.segment_profiles(seg, "market_segment")
