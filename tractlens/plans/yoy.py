"""YoY job as registered queries."""

from __future__ import annotations

from tractlens.functions.stats import materialize_small
from tractlens.operators import yoy
from tractlens.oracle.views import (APPLICATIONS, FIRST_LAST, TRACT_YEAR, YOY_CHANGES,
                                    rounded, with_ctes)
from tractlens.plans.registry import finalize, register
from tractlens.sources.tables import applications

TY_DOUBLES = ["approval_rate", "denial_rate", "withdrawal_rate", "avg_loan_amount",
              "median_loan_amount", "total_loan_volume", "avg_income", "median_income",
              "avg_dti", "median_dti", "avg_interest_rate", "median_interest_rate",
              "avg_property_value", "median_property_value", "conventional_pct", "fha_pct",
              "va_pct"]


#: I3's volume and rate limits, set to the size of these tables' tracts.
EMERGING = {"lo": 5, "hi": 100, "min_rate": 20.0}


def metrics(spark, sf):
    """The tract-year table, written once for a query: it is far smaller than the applications, and
    changes, ranks, trends and leaders all read it."""
    return materialize_small(yoy.tract_year_metrics(applications(spark, sf)))


@register("f3_tract_year_metrics", rounded(with_ctes(APPLICATIONS, TRACT_YEAR,
          body="SELECT * FROM tract_year"), TY_DOUBLES))
def f3(spark, sf):
    return finalize(yoy.tract_year_metrics(applications(spark, sf)))


@register("h1_yoy_changes", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, YOY_CHANGES,
          body="SELECT * FROM yoy_changes"),
          ["volume_change_pct", "approval_rate_change", "loan_amount_change_pct",
           "income_change_pct", "current_approval_rate", "current_avg_loan"]))
def h1(spark, sf):
    return finalize(yoy.yoy_changes(metrics(spark, sf)))


_TOP_MOVERS_SQL = with_ctes(APPLICATIONS, TRACT_YEAR, YOY_CHANGES, """
latest AS (
SELECT *, volume_change_pct * 0.4 + approval_rate_change * 0.6 AS improvement_score
FROM yoy_changes WHERE to_year = (SELECT max(to_year) FROM yoy_changes)),
ranked AS (
SELECT *, row_number() OVER (ORDER BY improvement_score DESC, census_tract) AS up_rank,
          row_number() OVER (ORDER BY improvement_score ASC, census_tract) AS down_rank
FROM latest WHERE improvement_score IS NOT NULL)""", body="""
SELECT census_tract, to_year, volume_change_pct, approval_rate_change, improvement_score,
       current_volume, current_approval_rate, market_segment, 'improver' AS direction,
       CAST(up_rank AS INT) AS rank FROM ranked WHERE up_rank <= 10
UNION ALL
SELECT census_tract, to_year, volume_change_pct, approval_rate_change, improvement_score,
       current_volume, current_approval_rate, market_segment, 'decliner' AS direction,
       CAST(down_rank AS INT) AS rank FROM ranked WHERE down_rank <= 10""")


@register("i1_top_movers", rounded(_TOP_MOVERS_SQL, ["volume_change_pct", "approval_rate_change",
                                                     "improvement_score", "current_approval_rate"]))
def i1(spark, sf):
    return finalize(yoy.top_movers(yoy.yoy_changes(metrics(spark, sf))))


@register("h10_first_last_year", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, FIRST_LAST,
          body="SELECT * FROM first_last"),
          ["volume_growth_pct", "approval_improvement", "current_approval_rate", "avg_loan_amount"]))
def h10(spark, sf):
    return finalize(yoy.first_last(metrics(spark, sf)))


@register("i2_growth_leaders", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, FIRST_LAST, body="""
SELECT census_tract, volume_growth_pct, approval_improvement, current_volume,
       current_approval_rate, market_segment
FROM first_last WHERE volume_growth_pct > 20 AND approval_improvement > 5
ORDER BY volume_growth_pct DESC, census_tract LIMIT 10"""),
          ["volume_growth_pct", "approval_improvement", "current_approval_rate"]))
def i2(spark, sf):
    return finalize(yoy.growth_leaders(metrics(spark, sf)))


@register("i3_emerging_markets", rounded(with_ctes(APPLICATIONS, TRACT_YEAR, FIRST_LAST, body="""
SELECT census_tract, current_volume, current_approval_rate, volume_growth_pct,
       market_segment, avg_loan_amount
FROM first_last WHERE current_volume BETWEEN 5 AND 100 AND current_approval_rate >= 20
  AND volume_growth_pct > 0
ORDER BY volume_growth_pct DESC, census_tract LIMIT 15"""),
          ["current_approval_rate", "volume_growth_pct", "avg_loan_amount"]))
def i3(spark, sf):
    return finalize(yoy.emerging_markets(metrics(spark, sf), **EMERGING))
