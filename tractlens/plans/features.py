"""Application feature jobs as registered queries."""

from __future__ import annotations

from tractlens.operators import features as fe
from tractlens.oracle.sqlfn import bands_sql, clip_sql, map_sql, nan_mean_sql
from tractlens.oracle.views import APPLICATIONS, rounded, with_ctes
from tractlens.plans.opportunity import SCORED_CTES, scored
from tractlens.plans.registry import finalize, register
from tractlens.plans.validation import DTI_SQL, MODEL_INPUT_SQL, model_input
from tractlens.sources.tables import applications, applications_wide

FIN_COLS = ["application_id", "loan_to_income_ratio", "income_adequacy", "monthly_payment", "monthly_income",
            "payment_to_income_ratio", "down_payment", "down_payment_ratio", "loan_to_value_calculated",
            "down_payment_adequacy", "debt_to_income_ratio", "dti_risk_category", "dti_compliant",
            "loan_size_category", "financial_risk_score", "financial_risk_category"]
FIN_DOUBLES = ["loan_to_income_ratio", "monthly_payment", "monthly_income", "payment_to_income_ratio",
               "down_payment", "down_payment_ratio", "loan_to_value_calculated", "debt_to_income_ratio",
               "financial_risk_score"]

_R = "(interest_rate / 100 / 12)"
_G = f"pow(1 + {_R}, loan_term)"
FIN_SQL = with_ctes(APPLICATIONS, MODEL_INPUT_SQL, f"""
fin0 AS (
SELECT m.application_id, m.income, m.loan_amount, m.property_value, m.debt_to_income_ratio,
       a.interest_rate, CAST(a.loan_term AS DOUBLE) AS loan_term, a.loan_purpose, a.occupancy_type,
       m.income * 1000 AS actual_income,
       CASE WHEN m.income > 0 AND m.loan_amount > 0 THEN m.loan_amount / (m.income * 1000) END AS loan_to_income_ratio,
       CASE WHEN m.property_value > 0 AND m.loan_amount > 0 THEN m.property_value - m.loan_amount END AS down_payment,
       CASE WHEN m.property_value > 0 AND m.loan_amount > 0
            THEN (m.property_value - m.loan_amount) / m.property_value END AS down_payment_ratio,
       CASE WHEN m.property_value > 0 AND m.loan_amount > 0 THEN m.loan_amount / m.property_value END
            AS loan_to_value_calculated
FROM model_input m JOIN applications a ON m.application_id = a.application_id)""", f"""
fin AS (
SELECT *,
       {bands_sql('loan_to_income_ratio', fe.INCOME_ADEQUACY)} AS income_adequacy,
       CASE WHEN interest_rate > 0 AND loan_term > 0 AND {_G} - 1 <> 0
            THEN loan_amount * ({_R} * {_G} / ({_G} - 1)) END AS monthly_payment,
       CASE WHEN interest_rate > 0 AND loan_term > 0 THEN actual_income / 12 END AS monthly_income,
       {bands_sql('down_payment_ratio', fe.DOWN_PAYMENT_ADEQUACY)} AS down_payment_adequacy,
       {bands_sql('debt_to_income_ratio', fe.DTI_RISK)} AS dti_risk_category,
       CAST(coalesce(debt_to_income_ratio <= 43, FALSE) AS INT) AS dti_compliant,
       {bands_sql('loan_amount', fe.LOAN_SIZE)} AS loan_size_category,
       {nan_mean_sql([clip_sql('debt_to_income_ratio / 60', 0, 1), clip_sql('loan_to_value_calculated', 0, 1),
                      clip_sql('loan_to_income_ratio / 6', 0, 1)])} AS financial_risk_score
FROM fin0)""", """
fin2 AS (
SELECT *, CASE WHEN interest_rate > 0 AND loan_term > 0 AND monthly_income > 0
               THEN monthly_payment / monthly_income END AS payment_to_income_ratio
FROM fin)""", body=f"""
SELECT {', '.join(c for c in FIN_COLS if c != 'financial_risk_category')},
       {bands_sql('financial_risk_score', fe.FIN_RISK)} AS financial_risk_category
FROM fin2""")


def _fin(spark, sf, winsor=False):
    return fe.financial_features(applications(spark, sf), winsorize_numeric=winsor)


@register("d1_d8_financial_features", rounded(FIN_SQL, FIN_DOUBLES))
def d1(spark, sf):
    return finalize(_fin(spark, sf).select(*FIN_COLS))


_CREDIT_PARTS = [f"(1.0 - {clip_sql('debt_to_income_ratio / 60', 0, 1)}) * 0.3",
                 f"{clip_sql('down_payment_ratio * 2', 0, 1)} * 0.25",
                 f"(1.0 - {clip_sql('loan_to_income_ratio / 5', 0, 1)}) * 0.25",
                 f"{map_sql('loan_purpose', fe.PURPOSE_SCORE, fe.PURPOSE_DEFAULT)} * 0.1",
                 f"{map_sql('occupancy_type', fe.OCCUPANCY_SCORE, fe.OCCUPANCY_DEFAULT)} * 0.1"]


@register("d9_credit_score_proxy", rounded(FIN_SQL.replace(
    "SELECT " + ', '.join(c for c in FIN_COLS if c != 'financial_risk_category'),
    "SELECT application_id, proxy AS credit_score_proxy, " + bands_sql('proxy', fe.CREDIT_PROXY)
    + " AS credit_score_category FROM (SELECT application_id, 300.0 + (" + " + ".join(_CREDIT_PARTS)
    + ") * 550 AS proxy").replace(
    "       " + bands_sql('financial_risk_score', fe.FIN_RISK) + " AS financial_risk_category\nFROM fin2",
    "FROM fin2)"), ["credit_score_proxy"]))
def d9(spark, sf):
    return finalize(fe.credit_score_proxy(_fin(spark, sf))
                    .select("application_id", "credit_score_proxy", "credit_score_category"))


@register("d13_denial_reason_features", with_ctes(APPLICATIONS, body="""
SELECT application_id,
       CAST((coalesce(denial_reason_1, 0) > 0)::INT + (coalesce(denial_reason_2, 0) > 0)::INT AS INT) AS num_denial_reasons,
       CAST((coalesce(denial_reason_1, 0) > 0 OR coalesce(denial_reason_2, 0) > 0) AS INT) AS has_denial_reason,
""" + ",\n".join(f"       CAST((coalesce(denial_reason_1, 0) = {k} OR coalesce(denial_reason_2, 0) = {k}) AS INT) AS {n}"
                 for k, n in fe.DENIAL_FLAGS.items()) + "\nFROM applications"))
def d13(spark, sf):
    a = applications(spark, sf).select("application_id", "denial_reason_1", "denial_reason_2")
    return fe.denial_reason_features(a).drop("denial_reason_1", "denial_reason_2")


@register("d14_loan_product_features", rounded(with_ctes(APPLICATIONS, body=f"""
SELECT application_id, CAST(loan_type AS DOUBLE) AS loan_type,
       coalesce({map_sql('loan_type', fe.LOAN_TYPE_RISK)}, 'unknown') AS loan_type_risk,
       interest_rate, {bands_sql('interest_rate', fe.RATE_BANDS)} AS interest_rate_category,
       CAST(loan_term AS DOUBLE) AS loan_term, {bands_sql('loan_term', fe.TERM_BANDS)} AS loan_term_category,
       CASE WHEN loan_to_value_ratio IS NULL OR loan_to_value_ratio IN ('nan', 'NA', '', 'Exempt') THEN NULL
            WHEN TRY_CAST(replace(loan_to_value_ratio, '%', '') AS DOUBLE) > 1
                 THEN TRY_CAST(replace(loan_to_value_ratio, '%', '') AS DOUBLE) / 100
            ELSE TRY_CAST(replace(loan_to_value_ratio, '%', '') AS DOUBLE) END AS loan_to_value_ratio
FROM applications"""), ["loan_type", "interest_rate", "loan_term", "loan_to_value_ratio"]))
def d14(spark, sf):
    a = applications(spark, sf).select("application_id", "loan_type", "interest_rate", "loan_term",
                                       "loan_to_value_ratio")
    return finalize(fe.loan_product_features(a))


@register("d15_engineer_all_features")
def d15(spark, sf):
    return fe.engineer_all_features(applications(spark, sf, deal_out=True))


_WIDE_SQL = """
wide AS (
SELECT *, CAST(applicant_race AS VARCHAR) AS "applicant_race-1",
       CASE WHEN application_id % 3 = 0 THEN '5' ELSE CAST(application_id % 2 + 1 AS VARCHAR) END AS "co-applicant_sex",
       CASE WHEN application_id % 11 <> 0 THEN CAST(application_id % 90 + 18 AS INT) END AS applicant_age,
       CASE WHEN application_id % 17 <> 0 THEN CAST(application_id % 90 + 60 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
         AS tract_to_msa_income_percentage,
       CAST(application_id % 101 AS DOUBLE) AS tract_minority_population_percent,
       CASE WHEN application_id % 7 <> 0 THEN (application_id % 80 - 10) / CAST(10 AS DOUBLE) END AS rate_spread
FROM applications)"""
_ENCODED = ["applicant_race-1", "applicant_sex", "co-applicant_sex", "county_code", "census_tract"]


@register("d10_label_encoding", with_ctes(APPLICATIONS, _WIDE_SQL, body="SELECT application_id, " + ", ".join(
    f"""CAST(dense_rank() OVER (ORDER BY coalesce(CAST("{c}" AS VARCHAR), 'nan')) - 1 AS INT) AS "{c}_encoded" """
    for c in _ENCODED) + " FROM wide"))
def d10(spark, sf):
    w = applications_wide(spark, sf).select("application_id", *[f"`{c}`" for c in _ENCODED])
    return fe.label_encode(w, _ENCODED).select("application_id", *[f"`{c}_encoded`" for c in _ENCODED])


@register("d11_demographic_features", with_ctes(APPLICATIONS, _WIDE_SQL, body=f"""
SELECT application_id, {bands_sql("CAST(applicant_age AS DOUBLE)", fe.AGE_BANDS)} AS applicant_age_category,
       CAST("co-applicant_sex" <> '5' AS INT) AS joint_application FROM wide"""))
def d11(spark, sf):
    return fe.demographic_features(applications_wide(spark, sf), encode=False).select(
        "application_id", "applicant_age_category", "joint_application")


@register("d12_geographic_features", with_ctes(APPLICATIONS, _WIDE_SQL, body=f"""
SELECT application_id, {bands_sql("tract_to_msa_income_percentage", fe.TRACT_INCOME)} AS tract_income_category,
       {bands_sql("tract_minority_population_percent", fe.MINORITY)} AS minority_concentration FROM wide"""))
def d12(spark, sf):
    return fe.geographic_features(applications_wide(spark, sf), encode=False).select(
        "application_id", "tract_income_category", "minority_concentration")


@register("d14_rate_spread_category", rounded(with_ctes(APPLICATIONS, _WIDE_SQL, body=f"""
SELECT application_id, rate_spread, {bands_sql("rate_spread", fe.SPREAD_BANDS)} AS rate_spread_category FROM wide"""),
    ["rate_spread"]))
def d14_spread(spark, sf):
    return finalize(fe.loan_product_features(applications_wide(spark, sf).select("application_id", "rate_spread")))


_LPS_DOUBLES = ["income", "loan_amount", "property_value", "debt_to_income_ratio", "loan_to_value_ratio",
                "loan_to_income_ratio", "property_to_income_ratio", "risk_score"]


@register("d18_d19_lps_features", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body=f"""
SELECT *, CASE WHEN income * 1000 = 0 THEN NULL ELSE loan_amount / (income * 1000) END AS loan_to_income_ratio,
       CASE WHEN income * 1000 = 0 THEN NULL ELSE property_value / (income * 1000) END AS property_to_income_ratio,
       {bands_sql('CAST(credit_score AS DOUBLE)', fe.LPS_CREDIT)} AS credit_score_category,
       {bands_sql('income', fe.LPS_INCOME)} AS income_category,
       {bands_sql('loan_amount', fe.LPS_LOAN)} AS loan_amount_category,
       {fe.LPS_CURRENT_YEAR} - activity_year AS loan_age_years,
       CAST(coalesce(loan_to_value_ratio > 90, FALSE) AS INT) AS high_ltv,
       CAST(coalesce(debt_to_income_ratio > 43, FALSE) AS INT) AS high_dti,
       CAST(coalesce(credit_score < 620, FALSE) AS INT) AS low_credit,
       {clip_sql("(850 - credit_score) / 550 * 40 + (CASE WHEN debt_to_income_ratio / 50 * 35 > 35 THEN 35.0 ELSE debt_to_income_ratio / 50 * 35 END) + (CASE WHEN (loan_to_value_ratio - 50) / 50 * 25 < 0 THEN 0.0 ELSE (loan_to_value_ratio - 50) / 50 * 25 END)", 0, 100)} AS risk_score
FROM model_input"""), _LPS_DOUBLES))
def d18(spark, sf):
    return finalize(fe.lps_features(model_input(spark, sf)))


@register("d20_one_hot_drop_first", with_ctes(APPLICATIONS, body="""
SELECT application_id,
       CAST(coalesce(CAST(loan_purpose AS VARCHAR) = '2', FALSE) AS INT) AS loan_purpose_2,
       CAST(coalesce(CAST(loan_purpose AS VARCHAR) = '3', FALSE) AS INT) AS loan_purpose_3,
       CAST(coalesce(CAST(loan_purpose AS VARCHAR) = '31', FALSE) AS INT) AS loan_purpose_31,
       CAST(coalesce(CAST(loan_purpose AS VARCHAR) = '32', FALSE) AS INT) AS loan_purpose_32
FROM applications"""))
def d20(spark, sf):
    a = applications(spark, sf).select("application_id", "loan_purpose")
    return fe.one_hot_drop_first(a, "loan_purpose", ["1", "2", "3", "31", "32"]).drop("loan_purpose")


@register("d25_risk_tiers", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body="""
SELECT application_id,
       CASE WHEN credit_score IS NULL THEN NULL WHEN credit_score >= 740 THEN 'Low' WHEN credit_score >= 670 THEN 'Medium'
            WHEN credit_score >= 580 THEN 'High' ELSE 'Very High' END AS credit_risk,
       CASE WHEN debt_to_income_ratio IS NULL THEN NULL WHEN debt_to_income_ratio <= 28 THEN 'Low'
            WHEN debt_to_income_ratio <= 36 THEN 'Medium' WHEN debt_to_income_ratio <= 43 THEN 'High'
            ELSE 'Very High' END AS dti_risk,
       CASE WHEN loan_to_value_ratio IS NULL THEN NULL WHEN loan_to_value_ratio <= 80 THEN 'Low'
            WHEN loan_to_value_ratio <= 90 THEN 'Medium' WHEN loan_to_value_ratio <= 95 THEN 'High'
            ELSE 'Very High' END AS ltv_risk
FROM model_input"""), []))
def d25(spark, sf):
    return fe.risk_tiers(model_input(spark, sf)).select("application_id", "risk_factors.*")


@register("d24_clustering_features", rounded(with_ctes(*SCORED_CTES, body="""
SELECT census_tract,
       avg_loan_amount / (median_household_income + 1) AS loan_to_income,
       approval_rate / (denial_rate + 0.01) AS approval_denial_ratio,
       loan_count / (total_population + 1) * 1000 AS loans_per_capita
FROM scored_final"""), ["loan_to_income", "approval_denial_ratio", "loans_per_capita"]))
def d24(spark, sf):
    return finalize(fe.clustering_features(scored(spark, sf))
                    .select("census_tract", "loan_to_income", "approval_denial_ratio", "loans_per_capita"))


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM model_input WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, {c} LIMIT 1)")


_B20_SQL = with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body=f"""
SELECT application_id, activity_year,
       coalesce(action_taken, {_mode_sql('action_taken')}, 0) AS action_taken,
       coalesce(income, (SELECT coalesce(median(income), 75.0) FROM model_input)) AS income,
       coalesce(loan_amount, (SELECT coalesce(median(loan_amount), 200000.0) FROM model_input)) AS loan_amount,
       coalesce(property_value, (SELECT coalesce(median(property_value), 250000.0) FROM model_input)) AS property_value,
       coalesce(credit_score, {_mode_sql('credit_score')}, 0) AS credit_score,
       coalesce(debt_to_income_ratio, {_mode_sql('debt_to_income_ratio')}, 0.0) AS debt_to_income_ratio,
       coalesce(loan_to_value_ratio, {_mode_sql('loan_to_value_ratio')}, 0.0) AS loan_to_value_ratio
FROM model_input""")


@register("b20_impute_for_model", rounded(_B20_SQL, ["income", "loan_amount", "property_value",
                                                     "debt_to_income_ratio", "loan_to_value_ratio"]))
def b20(spark, sf):
    return finalize(fe.impute_for_model(model_input(spark, sf)))


def _prediction_sql(source: str, age: str, race: str) -> str:
    """D17 row by row: parsed ratios, derived ratios, bands, stepwise proxy, risk, payment, fixed codes."""
    def steps(c: str) -> str:
        return "(CASE " + " ".join(f"WHEN {c} > {lim} THEN {cut}" for lim, cut in fe.PRED_STEPS[c]) + " ELSE 0 END)"

    def band(x: str, c: str) -> str:
        return f"coalesce({bands_sql(x, fe.PRED_CATEGORIES[c], True)}, 'nan') AS {c}"

    codes = {c: {lab: i for i, lab in enumerate(sorted(labels))} for c, (_, labels) in fe.PRED_CATEGORIES.items()}
    encoded = [f"(CASE " + " ".join(f"WHEN {c} = '{k}' THEN {i}" for k, i in m.items()) + f" ELSE {len(m) // 2} END) AS {c}_encoded" for c, m in codes.items()]
    number = lambda x: f"CASE WHEN {x} IS NULL OR isnan(CAST({x} AS DOUBLE)) OR isinf(CAST({x} AS DOUBLE)) THEN 0.0 ELSE CAST({x} AS DOUBLE) END"
    risk = " + ".join(f"{clip_sql(f'{c} * {k}', 0, 100)} * {w}" for c, k, w in (
        ("debt_to_income_ratio", 2, 0.4), ("loan_to_value_calculated", 1.2, 0.35), ("loan_to_income_ratio", 20, 0.25)))
    return rounded(with_ctes(APPLICATIONS, _WIDE_SQL, f"""
p0 AS (SELECT application_id, {DTI_SQL} AS debt_to_income_ratio, TRY_CAST(replace(trim(loan_to_value_ratio), '%', '') AS DOUBLE) AS loan_to_value_ratio,
       property_value, loan_amount, income, interest_rate, CAST(loan_term AS DOUBLE) AS loan_term, income * 1000 AS actual_income,
       CAST({age} AS DOUBLE) AS age, CAST({race} AS DOUBLE) AS applicant_race_encoded, CAST(applicant_sex AS DOUBLE) AS applicant_sex_encoded,
       interest_rate / 100 / 12 AS r FROM {source}),
p1 AS (SELECT *, coalesce(CASE WHEN income > 0 AND loan_amount > 0 THEN loan_amount / actual_income END, 0.0) AS loan_to_income_ratio,
       coalesce(CASE WHEN property_value > 0 AND loan_amount > 0 THEN loan_amount / property_value * 100 END, 80.0) AS loan_to_value_calculated,
       pow(1 + r, loan_term) AS g FROM p0),
p2 AS (SELECT *, 100.0 - loan_to_value_calculated AS down_payment_ratio, {band("debt_to_income_ratio", "dti_risk_category")},
       {band("loan_to_value_calculated", "ltv_risk_category")}, {band("loan_amount", "loan_size_category")}, {band("actual_income", "income_category")},
       {clip_sql("(850.0 - " + " - ".join(map(steps, fe.PRED_STEPS)) + ")", 300, 850)} AS credit_score_proxy,
       {clip_sql(f"({risk})", 0, 100)} AS financial_risk_score,
       loan_amount * (CASE WHEN g - 1 = 0 THEN NULL ELSE r * g / (g - 1) END) AS monthly_payment,
       CAST({bands_sql("age", fe.PRED_AGE, True)} AS DOUBLE) AS age_category FROM p1),
p3 AS (SELECT *, {band("credit_score_proxy", "credit_score_category")}, {band("financial_risk_score", "financial_risk_category")},
       (CASE WHEN actual_income / 12 = 0 THEN NULL ELSE monthly_payment / (actual_income / 12) END) * 100 AS payment_to_income_ratio FROM p2),
p4 AS (SELECT *, {", ".join(encoded)} FROM p3)""", body="SELECT application_id, " + ", ".join(
        f"{number(c)} AS {c}" for c in _PRED_NAMES) + " FROM p4"), _PRED_NAMES)


_PRED_NAMES = [*fe.PRED_FEATURES, *[f"{c}_encoded" for c in fe.PRED_CATEGORIES]]


@register("d17_prediction_features", _prediction_sql("wide", str(fe.PRED_DEFAULTS["applicant_age"]), str(fe.PRED_DEFAULTS["applicant_race-1"])))
def d17(spark, sf):
    a = applications(spark, sf).select("application_id", "income", "loan_amount", "property_value",
                                       "debt_to_income_ratio", "loan_to_value_ratio", "interest_rate", "loan_term",
                                       "applicant_sex")
    return finalize(fe.prediction_features(a))


@register("d16_prepare_for_modeling", _prediction_sql("wide", "applicant_age", '"applicant_race-1"'))
def d16(spark, sf):
    out, names = fe.prepare_for_modeling(fe.prediction_features(applications_wide(spark, sf)))
    return finalize(out.select("application_id", *names))
