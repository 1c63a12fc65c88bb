"""Validation job as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.functions import parse
from tractlens.operators import validate as v
from tractlens.oracle.validate_sql import clean_sql, report_sql
from tractlens.oracle.views import APPLICATIONS, CENSUS, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.sources.tables import APPLICATION_COLUMNS, applications, census

CENSUS_COLUMNS = ["census_tract", "total_population", "civilian_labor_force", "unemployed",
                  "median_household_income"]


def model_input(spark, sf):
    """Numeric application frame used by the loan-model checks."""
    a = applications(spark, sf)
    return a.select("application_id", "activity_year", "action_taken", "income", "loan_amount",
                    "property_value", "credit_score",
                    parse.dti_v2(F.col("debt_to_income_ratio")).alias("debt_to_income_ratio"),
                    parse.ltv_v1(F.col("loan_to_value_ratio")).alias("loan_to_value_ratio"))


_T = "replace(trim(debt_to_income_ratio), '%', '')"
DTI_SQL = f"""CASE WHEN debt_to_income_ratio IS NULL OR trim(debt_to_income_ratio) IN ('nan', 'NA', '', 'Exempt') THEN NULL
            WHEN starts_with({_T}, '>') THEN TRY_CAST(substr({_T}, 2) AS DOUBLE) + 5
            WHEN starts_with({_T}, '<') THEN greatest(0.0, TRY_CAST(substr({_T}, 2) AS DOUBLE) - 5)
            WHEN contains(debt_to_income_ratio, '-<')
                 THEN (TRY_CAST(split_part({_T}, '-<', 1) AS DOUBLE) + TRY_CAST(split_part({_T}, '-<', 2) AS DOUBLE)) / 2
            WHEN contains(debt_to_income_ratio, '-')
                 THEN (TRY_CAST(split_part({_T}, '-', 1) AS DOUBLE) + TRY_CAST(split_part({_T}, '-', 2) AS DOUBLE)) / 2
            ELSE TRY_CAST({_T} AS DOUBLE) END"""
MODEL_INPUT_SQL = f"""
model_input AS (
SELECT application_id, activity_year, action_taken, income, loan_amount, property_value, credit_score,
       {DTI_SQL} AS debt_to_income_ratio,
       CASE WHEN loan_to_value_ratio = 'Exempt' THEN NULL ELSE TRY_CAST(loan_to_value_ratio AS DOUBLE) END
            AS loan_to_value_ratio
FROM applications)"""
# Ratio texts are numbers before the rules see them.
PARSED_SQL = f"""
parsed AS (SELECT * REPLACE (CAST({DTI_SQL} AS VARCHAR) AS debt_to_income_ratio,
  CASE WHEN loan_to_value_ratio = 'Exempt' THEN NULL ELSE CAST(TRY_CAST(replace(loan_to_value_ratio, '%', '') AS DOUBLE) AS VARCHAR)
       END AS loan_to_value_ratio) FROM applications)"""


@register("b2_clean_hmda", with_ctes(APPLICATIONS, PARSED_SQL, body=clean_sql("parsed", APPLICATION_COLUMNS, "hmda", False)))
def b2_clean(spark, sf):
    return finalize(v.clean_dataframe(applications(spark, sf, deal_out=True), "hmda"))


@register("b2_report_hmda", with_ctes(APPLICATIONS, PARSED_SQL, body="SELECT * FROM (" +
                                      report_sql("parsed", APPLICATION_COLUMNS, "hmda", False) + ")"))
def b2_report(spark, sf):
    return v.validation_report(applications(spark, sf, deal_out=True), "hmda")


@register("b3_clean_hmda_strict", with_ctes(APPLICATIONS, PARSED_SQL, body=clean_sql("parsed", APPLICATION_COLUMNS, "hmda", True)))
def b3_strict(spark, sf):
    return finalize(v.clean_dataframe(applications(spark, sf), "hmda", strict=True))


@register("b5_report_hmda_strict", with_ctes(APPLICATIONS, PARSED_SQL, body="SELECT * FROM (" +
                                            report_sql("parsed", APPLICATION_COLUMNS, "hmda", True) + ")"))
def b5_report_strict(spark, sf):
    return v.validation_report(applications(spark, sf), "hmda", strict=True)


@register("b8_clean_census", with_ctes(CENSUS, body=clean_sql("census", CENSUS_COLUMNS, "census", False)))
def b8_census(spark, sf):
    return finalize(v.clean_dataframe(census(spark, sf), "census"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@register("b13_validation_summary", with_ctes(APPLICATIONS, PARSED_SQL, CENSUS, f"""
reports AS (SELECT * FROM ({report_sql("parsed", APPLICATION_COLUMNS, "hmda", False)}) UNION ALL
            SELECT * FROM ({report_sql("parsed", APPLICATION_COLUMNS, "hmda", True)}) UNION ALL
            SELECT * FROM ({report_sql("census", CENSUS_COLUMNS, "census", False)}))""", """
summ AS (SELECT regexp_extract(message, 'status=(\\w+)', 1) AS status, count AS n,
                CAST(regexp_extract(message, 'values_sanitized=(\\d+)', 1) AS BIGINT) AS s FROM reports WHERE "check" = 'summary')""", """
tot AS (SELECT count(*) AS total_datasets, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'warnings') AS with_warnings,
               count(*) FILTER (status = 'errors') AS with_errors, CAST(sum(n) AS BIGINT) AS total_rows_processed, CAST(sum(s) AS BIGINT) AS total_values_sanitized
        FROM summ)""", """
flags AS (SELECT count(*) FILTER (severity = 'error' AND contains(lower(message), 'income') AND contains(lower(message), 'missing')) AS inc,
                 count(*) FILTER (severity = 'warning' AND contains(lower(message), 'ratio')) AS ratio FROM reports WHERE "check" <> 'summary')""", """
common AS (SELECT coalesce(string_agg(issue || '=' || n, '; ' ORDER BY issue), '') AS common_issues FROM (
  SELECT split_part(message, ':', 1) AS issue, count(*) AS n FROM reports WHERE "check" <> 'summary' AND severity = 'error' GROUP BY 1))""", body=f"""
SELECT tot.*, common_issues, CASE WHEN len(recs) = 0 THEN {_text(v.REC_OK)} ELSE array_to_string(recs, ' | ') END AS recommendations
FROM (SELECT list_filter([CASE WHEN with_errors > 0 THEN {_text(v.REC_ERRORS)} END,
                          CASE WHEN total_values_sanitized > total_rows_processed * 0.1 THEN {_text(v.REC_SANITIZE)} END,
                          CASE WHEN inc > 0 THEN {_text(v.REC_INCOME)} END, CASE WHEN ratio > 0 THEN {_text(v.REC_RATIO)} END], lambda x: x IS NOT NULL) AS recs
      FROM tot, flags), tot, common"""))
def b13(spark, sf):
    a = applications(spark, sf)
    reports = (v.validation_report(a, "hmda").unionByName(v.validation_report(a, "hmda", strict=True))
               .unionByName(v.validation_report(census(spark, sf), "census")))
    issue = lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))
    return v.validation_summary(reports).withColumns({
        "common_issues": F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("common_issues")), issue), "; "), F.lit("")),
        "recommendations": F.array_join("recommendations", " | ")})


@register("b11_validate_applications")
def b11(spark, sf):
    return v.validate_applications(model_input(spark, sf))


_B15 = with_ctes(APPLICATIONS, MODEL_INPUT_SQL, """
b15 AS (SELECT * FROM model_input WHERE action_taken IS NOT NULL AND income IS NOT NULL
        AND loan_amount IS NOT NULL AND credit_score IS NOT NULL)""", """
s1 AS (SELECT b.* FROM b15 b, (SELECT quantile_cont(income, 0.25) q1, quantile_cont(income, 0.75) q3 FROM b15) q
       WHERE income >= q1 - (q3 - q1) * 1.5 AND income <= q3 + (q3 - q1) * 1.5)""", """
s2 AS (SELECT b.* FROM s1 b, (SELECT quantile_cont(loan_amount, 0.25) q1, quantile_cont(loan_amount, 0.75) q3 FROM s1) q
       WHERE loan_amount >= q1 - (q3 - q1) * 1.5 AND loan_amount <= q3 + (q3 - q1) * 1.5)""", """
s3 AS (SELECT b.* FROM s2 b, (SELECT quantile_cont(property_value, 0.25) q1, quantile_cont(property_value, 0.75) q3 FROM s2) q
       WHERE property_value >= q1 - (q3 - q1) * 1.5 AND property_value <= q3 + (q3 - q1) * 1.5)""", """
s4 AS (SELECT b.* FROM s3 b, (SELECT quantile_cont(credit_score, 0.25) q1, quantile_cont(credit_score, 0.75) q3 FROM s3) q
       WHERE credit_score >= q1 - (q3 - q1) * 1.5 AND credit_score <= q3 + (q3 - q1) * 1.5)""",
                  body="""
SELECT * FROM s4 WHERE income >= 10 AND income <= 1000 AND credit_score >= 300 AND credit_score <= 850
  AND debt_to_income_ratio >= 0 AND debt_to_income_ratio <= 100
  AND loan_to_value_ratio >= 10 AND loan_to_value_ratio <= 100""")


@register("b15_b17_model_input_validation", rounded(_B15, ["income", "loan_amount", "property_value",
                                                           "debt_to_income_ratio", "loan_to_value_ratio"]))
def b15(spark, sf):
    return finalize(v.model_input_validation(model_input(spark, sf)))


_B18 = with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body="""
SELECT application_id,
       CASE WHEN income IS NULL THEN 'Field cannot be empty: income'
            WHEN loan_amount IS NULL THEN 'Field cannot be empty: loan_amount'
            WHEN property_value IS NULL THEN 'Field cannot be empty: property_value'
            WHEN credit_score IS NULL THEN 'Field cannot be empty: credit_score'
            WHEN debt_to_income_ratio IS NULL THEN 'Field cannot be empty: debt_to_income_ratio'
            WHEN loan_to_value_ratio IS NULL THEN 'Field cannot be empty: loan_to_value_ratio'
            WHEN income < 10 OR income > 1000 THEN 'income must be between 10 and 1000'
            WHEN loan_amount < 10000 OR loan_amount > 5000000 THEN 'loan_amount must be between 10000 and 5000000'
            WHEN property_value < 15000 OR property_value > 10000000 THEN 'property_value must be between 15000 and 10000000'
            WHEN credit_score < 300 OR credit_score > 850 THEN 'credit_score must be between 300 and 850'
            WHEN debt_to_income_ratio < 0 OR debt_to_income_ratio > 100 THEN 'debt_to_income_ratio must be between 0 and 100'
            WHEN loan_to_value_ratio < 10 OR loan_to_value_ratio > 100 THEN 'loan_to_value_ratio must be between 10 and 100'
            ELSE '' END AS error_message
FROM model_input""")


@register("b18_input_check", "SELECT *, error_message = '' AS is_valid FROM (" + _B18 + ")")
def b18(spark, sf):
    return v.input_check(model_input(spark, sf)).select("application_id", "error_message", "is_valid")


_B19_SQL = with_ctes(APPLICATIONS, body=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count,
       CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count,
       100.0 - count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100 AS pct_valid FROM applications"""
    for c in APPLICATION_COLUMNS))


@register("b19_profile", rounded(_B19_SQL, ["pct_valid"]))
def b19(spark, sf):
    return finalize(v.profile(applications(spark, sf)))


@register("j3_duplicate_count", with_ctes(APPLICATIONS, body="""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM applications)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM applications)) AS duplicate_rows
FROM applications"""))
def j3(spark, sf):
    return v.duplicate_count(applications(spark, sf))


@register("b21_winsorize", rounded(with_ctes(APPLICATIONS, body="""
SELECT application_id,
       CASE WHEN loan_amount < lo1 THEN lo1 WHEN loan_amount > hi1 THEN hi1 ELSE loan_amount END AS loan_amount,
       CASE WHEN income IS NULL THEN NULL WHEN income < lo2 THEN lo2 WHEN income > hi2 THEN hi2 ELSE income END AS income
FROM applications, (SELECT quantile_cont(loan_amount, 0.001) lo1, quantile_cont(loan_amount, 0.999) hi1,
                           quantile_cont(income, 0.001) lo2, quantile_cont(income, 0.999) hi2 FROM applications)"""),
          ["loan_amount", "income"]))
def b21(spark, sf):
    a = applications(spark, sf).select("application_id", "loan_amount", "income")
    return finalize(v.winsorize(a, ["loan_amount", "income"]))


@register("b22_finite_fill", rounded(with_ctes(APPLICATIONS, body="""
SELECT application_id, coalesce(income, 0.0) AS income, coalesce(property_value, 0.0) AS property_value
FROM applications"""), ["income", "property_value"]))
def b22(spark, sf):
    a = applications(spark, sf).select("application_id", "income", "property_value")
    return finalize(v.finite_fill(a, ["income", "property_value"]))
