"""DuckDB oracle text for the tract-level jobs (rollups, master, scores)."""

from __future__ import annotations

from tractlens.operators import opportunity as opp


def r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


CLEAN = """
clean AS (
SELECT * REPLACE (CAST(CAST(TRY_CAST(census_tract AS DOUBLE) AS BIGINT) AS VARCHAR) AS census_tract)
FROM applications
WHERE census_tract IS NOT NULL AND action_taken BETWEEN 1 AND 8)"""


def _mode_cte(name: str) -> str:
    return f"""
{name}_cnt AS (SELECT census_tract, action_taken, count(*) AS c FROM clean GROUP BY 1, 2),
{name}_mode AS (
SELECT census_tract, action_taken AS most_common_action FROM (
  SELECT *, row_number() OVER (PARTITION BY census_tract ORDER BY c DESC, action_taken) AS rn
  FROM {name}_cnt) WHERE rn = 1)"""


ROLLUP_V2 = _mode_cte("r2") + f""",
rollup_v2 AS (
SELECT a.census_tract, count(loan_amount) AS loan_count,
       {r2('avg(loan_amount)')} AS avg_loan_amount, {r2('median(loan_amount)')} AS median_loan_amount,
       {r2('avg(income)')} AS avg_income, {r2('median(income)')} AS median_income,
       {r2('avg(TRY_CAST(debt_to_income_ratio AS DOUBLE))')} AS avg_dti,
       {r2('avg(TRY_CAST(loan_to_value_ratio AS DOUBLE))')} AS avg_ltv,
       CAST(sum(CASE WHEN action_taken IN (1, 2, 6, 8) THEN 1 ELSE 0 END) AS BIGINT) AS total_approved,
       {r2('avg(CASE WHEN action_taken IN (1, 2, 6, 8) THEN 1 ELSE 0 END)')} AS approval_rate,
       CAST(sum(CASE WHEN action_taken = 3 THEN 1 ELSE 0 END) AS BIGINT) AS total_denied,
       {r2('avg(CASE WHEN action_taken = 3 THEN 1 ELSE 0 END)')} AS denial_rate,
       CAST(any_value(m.most_common_action) AS INT) AS most_common_action
FROM clean a JOIN r2_mode m ON a.census_tract = m.census_tract
GROUP BY a.census_tract)"""

_DTI_V1 = """CASE WHEN debt_to_income_ratio IS NULL OR debt_to_income_ratio = 'Exempt' THEN NULL
     WHEN debt_to_income_ratio = '<20%' THEN 15.0 WHEN debt_to_income_ratio = '20%-<30%' THEN 25.0
     WHEN debt_to_income_ratio = '30%-<36%' THEN 33.0 WHEN debt_to_income_ratio = '50%-60%' THEN 55.0
     WHEN debt_to_income_ratio = '>60%' THEN 70.0
     ELSE TRY_CAST(debt_to_income_ratio AS DOUBLE) END"""

ROLLUP_V1 = _mode_cte("r1") + f""",
rollup_v1 AS (
SELECT a.census_tract, count(loan_amount) AS loan_count,
       {r2('avg(loan_amount)')} AS avg_loan_amount, {r2('median(loan_amount)')} AS median_loan_amount,
       {r2('avg(income)')} AS avg_income, {r2('median(income)')} AS median_applicant_income,
       {r2('avg(CAST(' + _DTI_V1 + ' AS DOUBLE))')} AS avg_debt_to_income_ratio,
       {r2("avg(CASE WHEN loan_to_value_ratio = 'Exempt' THEN NULL ELSE TRY_CAST(loan_to_value_ratio AS DOUBLE) END)")} AS avg_loan_to_value_ratio,
       CAST(sum(CASE WHEN action_taken IN (1, 2, 6, 8) THEN 1 ELSE 0 END) AS BIGINT) AS total_approved,
       {r2('avg(CASE WHEN action_taken IN (1, 2, 6, 8) THEN 1 ELSE 0 END)')} AS approval_rate,
       CAST(sum(CASE WHEN action_taken IN (3, 7) THEN 1 ELSE 0 END) AS BIGINT) AS total_denied,
       {r2('avg(CASE WHEN action_taken IN (3, 7) THEN 1 ELSE 0 END)')} AS denial_rate,
       CAST(any_value(m.most_common_action) AS INT) AS most_common_action
FROM clean a JOIN r1_mode m ON a.census_tract = m.census_tract
GROUP BY a.census_tract)"""

CENSUS_RATES = f"""
census_r AS (
SELECT *, {r2('unemployed / civilian_labor_force * CAST(100 AS DOUBLE)')} AS unemployment_rate FROM census)"""

HPI_LATEST = """
hpi_chg AS (
SELECT *, (hpi - lag(hpi) OVER (PARTITION BY census_tract ORDER BY year))
          / lag(hpi) OVER (PARTITION BY census_tract ORDER BY year) * CAST(100 AS DOUBLE) AS annual_change
FROM hpi),
hpi_latest AS (
SELECT census_tract, hpi, annual_change FROM (
  SELECT *, row_number() OVER (PARTITION BY census_tract ORDER BY year DESC) AS rn FROM hpi_chg)
WHERE rn = 1)"""

MASTER = """
master AS (
SELECT r.*, c.total_population, c.civilian_labor_force, c.unemployed, c.median_household_income,
       c.unemployment_rate, h.hpi, h.annual_change
FROM rollup_v2 r JOIN census_r c ON r.census_tract = c.census_tract
LEFT JOIN hpi_latest h ON r.census_tract = h.census_tract)"""


def _component_sql(recipe) -> str:
    terms = []
    for c, w, higher in recipe:
        norm = f"(CAST({c} AS DOUBLE) - mn_{c}) / (mx_{c} - mn_{c}) * CAST(100 AS DOUBLE)"
        val = norm if higher else f"(CAST(100 AS DOUBLE) - {norm})"
        terms.append(f"(CASE WHEN n_{c} = 0 THEN 50.0 WHEN mn_{c} = mx_{c} THEN 50.0 ELSE {val} END) * {w}")
    return "coalesce(" + " + ".join(terms) + ", CAST(50 AS DOUBLE))"


def scored_cte() -> str:
    cols = sorted({c for rec in (opp.ACCESSIBILITY, opp.RISK, opp.ECONOMIC, opp.ACTIVITY) for c, _, _ in rec})
    stats = ", ".join(f"CAST(min({c}) AS DOUBLE) AS mn_{c}, CAST(max({c}) AS DOUBLE) AS mx_{c}, count({c}) AS n_{c}"
                      for c in cols)
    w = opp.OPPORTUNITY_WEIGHTS
    return f"""
master_stats AS (SELECT {stats} FROM master),
comp AS (
SELECT m.*,
       {_component_sql(opp.ACCESSIBILITY)} AS market_accessibility,
       {_component_sql(opp.RISK)} AS risk_factors,
       {_component_sql(opp.ECONOMIC)} AS economic_indicators,
       {_component_sql(opp.ACTIVITY)} AS lending_activity
FROM master m CROSS JOIN master_stats),
scored AS (
SELECT *, {r2(f"market_accessibility * {w['market_accessibility']} + risk_factors * {w['risk_factors']} + economic_indicators * {w['economic_indicators']} + lending_activity * {w['lending_activity']}")} AS opportunity_score_raw
FROM comp),
scored_final AS (
SELECT * EXCLUDE (opportunity_score_raw), opportunity_score_raw AS opportunity_score,
       CASE WHEN opportunity_score_raw >= 75 THEN 'High' WHEN opportunity_score_raw >= 50 THEN 'Medium'
            ELSE 'Low' END AS opportunity_level
FROM scored)"""


SCORED_DOUBLES = ["avg_loan_amount", "median_loan_amount", "avg_income", "median_income", "avg_dti",
                  "avg_ltv", "approval_rate", "denial_rate", "median_household_income",
                  "unemployment_rate", "hpi", "annual_change", "market_accessibility", "risk_factors",
                  "economic_indicators", "lending_activity", "opportunity_score"]
