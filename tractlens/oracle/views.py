"""DuckDB SQL for the lending views and shared intermediate tables.

These strings are the independent oracle: the driver runs them in DuckDB next
to the Spark DataFrame code and compares the results.  They are written from
the formulas, not generated from the Spark plans.
"""

from __future__ import annotations

APPLICATIONS = """
applications AS (
SELECT o.o_orderkey AS application_id,
       CAST(year(o.o_orderdate) AS INT) AS activity_year,
       concat('20', lpad(CAST(c.c_nationkey AS VARCHAR), 3, '0')) AS county_code,
       concat('20', lpad(CAST(c.c_nationkey AS VARCHAR), 3, '0'),
              lpad(CAST(c.c_custkey % 8 AS VARCHAR), 6, '0')) AS census_tract,
       CAST(CASE WHEN o.o_orderkey % 20 < 11 THEN 1 WHEN o.o_orderkey % 20 = 11 THEN 2
                 WHEN o.o_orderkey % 20 < 16 THEN 3 WHEN o.o_orderkey % 20 = 16 THEN 4
                 WHEN o.o_orderkey % 20 = 17 THEN 5 WHEN o.o_orderkey % 20 = 18 THEN 6
                 WHEN o.o_orderkey % 40 = 19 THEN 7 ELSE 8 END AS INT) AS action_taken,
       o.o_totalprice AS loan_amount,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL
            ELSE (c.c_acctbal + CAST(1000.0 AS DOUBLE)) / CAST(50.0 AS DOUBLE) END AS income,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
            ELSE o.o_totalprice * CAST(100.0 AS DOUBLE) / CAST(40 + o.o_orderkey % 70 AS DOUBLE) END
            AS property_value,
       CASE o.o_orderkey % 9 WHEN 0 THEN '<20%' WHEN 1 THEN '20%-<30%' WHEN 2 THEN '30%-<36%'
            WHEN 3 THEN '36' WHEN 4 THEN '43' WHEN 5 THEN '49' WHEN 6 THEN '50%-60%'
            WHEN 7 THEN '>60%' ELSE 'Exempt' END AS debt_to_income_ratio,
       CASE WHEN o.o_orderkey % 31 = 0 THEN 'Exempt'
            ELSE CAST(40 + o.o_orderkey % 70 AS VARCHAR) END AS loan_to_value_ratio,
       CAST(30 + o.o_orderkey % 50 AS DOUBLE) / 10 AS interest_rate,
       CAST(CASE o.o_orderkey % 3 WHEN 0 THEN 180 WHEN 1 THEN 240 ELSE 360 END AS INT) AS loan_term,
       CAST(1 + o.o_orderkey % 4 AS INT) AS loan_type,
       CAST(CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2
                 WHEN 'FURNITURE' THEN 3 ELSE 31 END AS INT) AS loan_purpose,
       CAST(1 + o.o_orderkey % 2 AS INT) AS occupancy_type,
       CAST(1 + c.c_nationkey % 5 AS INT) AS applicant_race,
       CAST(1 + c.c_custkey % 2 AS INT) AS applicant_sex,
       CAST(300 + (o.o_orderkey * 37) % 551 AS INT) AS credit_score,
       CAST(CASE WHEN o.o_orderkey % 20 BETWEEN 12 AND 15
                 THEN 1 + o.o_orderkey % 9 ELSE 10 END AS INT) AS denial_reason_1,
       CAST(CASE WHEN o.o_orderkey % 20 BETWEEN 12 AND 13
                 THEN 1 + (o.o_orderkey * 7) % 9 END AS INT) AS denial_reason_2
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

CENSUS = """
census AS (
SELECT concat('20', lpad(CAST(c_nationkey AS VARCHAR), 3, '0'),
              lpad(CAST(c_custkey % 8 AS VARCHAR), 6, '0')) AS census_tract,
       CAST(count(*) * 400 AS BIGINT) AS total_population,
       CAST(count(*) * 220 AS BIGINT) AS civilian_labor_force,
       CAST(sum(CASE WHEN c_acctbal < 0 THEN 100 ELSE 5 END) AS BIGINT) AS unemployed,
       CAST(30000.0 AS DOUBLE) + CAST(8.0 AS DOUBLE) * median(c_acctbal) AS median_household_income
FROM customer GROUP BY 1)"""

HPI = """
hpi_cents AS (
SELECT l_orderkey, sum(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS sc,
       count(l_extendedprice / l_quantity) AS nc
FROM lineitem GROUP BY l_orderkey),
hpi AS (
SELECT concat('20', lpad(CAST(c.c_nationkey AS VARCHAR), 3, '0'),
              lpad(CAST(c.c_custkey % 8 AS VARCHAR), 6, '0')) AS census_tract,
       CAST(year(o.o_orderdate) AS INT) AS year,
       floor(sum(l.sc) / sum(l.nc) / 100 * 10000 + 0.5) / 10000 AS hpi
FROM hpi_cents l JOIN orders o ON l.l_orderkey = o.o_orderkey
                 JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2)"""

# tract x year metrics over ``applications``.
TRACT_YEAR = """
tym_base AS (
SELECT census_tract, activity_year AS year, action_taken, loan_type,
       loan_amount, income, interest_rate AS rate, property_value AS pv,
       TRY_CAST(regexp_replace(debt_to_income_ratio, '[%<>]', '', 'g') AS DOUBLE) AS dti
FROM applications WHERE census_tract IS NOT NULL),
tym_agg AS (
SELECT census_tract, year,
       count(*) AS total_applications,
       count(*) FILTER (WHERE action_taken = 1) AS total_originations,
       count(*) FILTER (WHERE action_taken = 3) AS total_denials,
       count(*) FILTER (WHERE action_taken = 4) AS total_withdrawals,
       avg(loan_amount) AS avg_loan_amount, median(loan_amount) AS median_loan_amount,
       coalesce(sum(CASE WHEN action_taken = 1 THEN loan_amount END), CAST(0 AS DOUBLE)) AS total_loan_volume,
       avg(income) AS avg_income, median(income) AS median_income,
       avg(dti) AS avg_dti, median(dti) AS median_dti,
       avg(rate) AS avg_interest_rate, median(rate) AS median_interest_rate,
       avg(pv) AS avg_property_value, median(pv) AS median_property_value,
       count(*) FILTER (WHERE loan_type = 1) AS lt1,
       count(*) FILTER (WHERE loan_type = 2) AS lt2,
       count(*) FILTER (WHERE loan_type = 3) AS lt3
FROM tym_base GROUP BY census_tract, year),
tym_rates AS (
SELECT *,
       CASE WHEN total_applications > 0 THEN total_originations / total_applications * CAST(100 AS DOUBLE) ELSE 0 END AS approval_rate,
       CASE WHEN total_applications > 0 THEN total_denials / total_applications * CAST(100 AS DOUBLE) ELSE 0 END AS denial_rate,
       CASE WHEN total_applications > 0 THEN total_withdrawals / total_applications * CAST(100 AS DOUBLE) ELSE 0 END AS withdrawal_rate,
       CASE WHEN total_applications > 0 THEN lt1 / total_applications * CAST(100 AS DOUBLE) ELSE 0 END AS conventional_pct,
       CASE WHEN total_applications > 0 THEN lt2 / total_applications * CAST(100 AS DOUBLE) ELSE 0 END AS fha_pct,
       CASE WHEN total_applications > 0 THEN lt3 / total_applications * CAST(100 AS DOUBLE) ELSE 0 END AS va_pct
FROM tym_agg),
tract_year AS (
SELECT census_tract, year, total_applications, total_originations, total_denials,
       total_withdrawals, approval_rate, denial_rate, withdrawal_rate,
       avg_loan_amount, median_loan_amount, total_loan_volume, avg_income, median_income,
       avg_dti, median_dti, avg_interest_rate, median_interest_rate,
       avg_property_value, median_property_value, conventional_pct, fha_pct, va_pct,
       CASE WHEN avg_loan_amount >= 400000 THEN 'Luxury' WHEN avg_loan_amount >= 250000 THEN 'Premium'
            WHEN avg_loan_amount >= 150000 THEN 'Mainstream' WHEN avg_loan_amount >= 100000 THEN 'Value'
            ELSE 'Affordable' END AS market_segment,
       CASE WHEN approval_rate >= 70 AND total_applications >= 50 THEN 'High Performer'
            WHEN approval_rate >= 60 AND total_applications >= 30 THEN 'Strong Performer'
            WHEN approval_rate >= 50 AND total_applications >= 15 THEN 'Moderate Performer'
            WHEN approval_rate >= 40 THEN 'Challenging Market'
            ELSE 'Difficult Market' END AS performance_tier
FROM tym_rates)"""

# H1: consecutive-year changes over ``tract_year``.
YOY_CHANGES = """
yoy_lagged AS (
SELECT *, lag(year) OVER w AS from_year, lag(total_applications) OVER w AS p_apps,
       lag(approval_rate) OVER w AS p_rate, lag(avg_loan_amount) OVER w AS p_loan,
       lag(avg_income) OVER w AS p_income
FROM tract_year WINDOW w AS (PARTITION BY census_tract ORDER BY year)),
yoy_changes AS (
SELECT census_tract, CAST(from_year AS INT) AS from_year, year AS to_year,
       CASE WHEN p_apps > 0 THEN (total_applications - p_apps) / p_apps * CAST(100 AS DOUBLE) ELSE 0 END AS volume_change_pct,
       approval_rate - p_rate AS approval_rate_change,
       CASE WHEN p_loan > 0 THEN (avg_loan_amount - p_loan) / p_loan * CAST(100 AS DOUBLE) ELSE 0 END AS loan_amount_change_pct,
       CASE WHEN p_income > 0 THEN (avg_income - p_income) / p_income * CAST(100 AS DOUBLE) ELSE 0 END AS income_change_pct,
       total_applications AS current_volume, approval_rate AS current_approval_rate,
       avg_loan_amount AS current_avg_loan, market_segment, performance_tier
FROM yoy_lagged WHERE from_year IS NOT NULL)"""

# First and last year per tract.
FIRST_LAST = """
fl_ranked AS (
SELECT *, count(*) OVER (PARTITION BY census_tract) AS n_years,
       row_number() OVER (PARTITION BY census_tract ORDER BY year) AS rn_first,
       row_number() OVER (PARTITION BY census_tract ORDER BY year DESC) AS rn_last
FROM tract_year),
first_last AS (
SELECT f.census_tract, f.n_years, f.year AS first_year, l.year AS last_year,
       CASE WHEN f.total_applications > 0
            THEN (l.total_applications - f.total_applications) / f.total_applications * CAST(100 AS DOUBLE)
            ELSE 0 END AS volume_growth_pct,
       l.approval_rate - f.approval_rate AS approval_improvement,
       l.total_applications AS current_volume, l.approval_rate AS current_approval_rate,
       l.market_segment AS market_segment, l.avg_loan_amount AS avg_loan_amount
FROM fl_ranked f JOIN fl_ranked l ON f.census_tract = l.census_tract
WHERE f.rn_first = 1 AND l.rn_last = 1 AND f.n_years >= 2)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def rounded(inner: str, doubles: list[str], digits: int = 6) -> str:
    """Round the double columns of ``inner`` like ``finalize`` does on the Spark side."""
    if not doubles:
        return inner
    sc = f"CAST({10 ** digits} AS DOUBLE)"
    rep = ", ".join(f"CASE WHEN isnan(CAST({c} AS DOUBLE)) OR abs(CAST({c} AS DOUBLE)) >= 1e12 THEN CAST({c} AS DOUBLE) "
                    f"ELSE floor(CAST({c} AS DOUBLE) * {sc} + 0.5) / {sc} END AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS _q"
