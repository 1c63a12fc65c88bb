"""Fitted preprocessing as registered queries: fitted on the years before the
last, applied to the last year's rows or to all."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tractlens.operators import features as fe
from tractlens.operators import preprocess as pp
from tractlens.oracle.sqlfn import bands_sql, clip_sql
from tractlens.oracle.views import APPLICATIONS, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.plans.validation import MODEL_INPUT_SQL, model_input
from tractlens.session import ensure_checkpoint_dir
from tractlens.sources.sinks import save_model
from tractlens.sources.tables import applications

_OLD = "activity_year < (SELECT max(activity_year) FROM applications)"


def before_last_year(df):
    """(training rows, rows of the last year)."""
    last = df.agg(F.max("activity_year")).first()[0]
    return df.filter(F.col("activity_year") < last), df.filter(F.col("activity_year") == last)


# D20 -------------------------------------------------------------------------------
HOT = ["loan_purpose", "debt_to_income_ratio", "county_code"]


@register("d20_one_hot_many", with_ctes(APPLICATIONS, f"""
cell AS (SELECT application_id, activity_year, unnest([1, 2, 3]) AS c,
         unnest([{", ".join(f"CAST({c} AS VARCHAR)" for c in HOT)}]) AS v FROM applications)""", f"""
cat AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS k FROM (SELECT DISTINCT c, v FROM cell WHERE {_OLD} AND v IS NOT NULL))""", """
slot AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS slot FROM cat WHERE k > 1)""", body="""
SELECT application_id, (SELECT count(*) FROM slot) AS n_slots, coalesce(string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot), '') AS active
FROM cell LEFT JOIN slot USING (c, v) GROUP BY application_id"""))
def d20_many(spark, sf):
    a = applications(spark, sf).select("application_id", "activity_year", *HOT)
    model = pp.OneHot(inputCols=HOT, vectorCol="hot").fit(before_last_year(a)[0])
    values = vector_to_array("hot")
    active = F.filter(F.transform(values, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return model.transform(a).select("application_id", F.size(values).cast("long").alias("n_slots"), F.array_join(active, ",").alias("active"))


# D21 -------------------------------------------------------------------------------
SCALED = ["income", "loan_amount", "property_value", "credit_score", "debt_to_income_ratio", "loan_to_value_ratio"]
_STATS = {
    "standard": lambda c: (f"avg({c})", f"stddev_pop({c})"),
    "minmax": lambda c: (f"min({c})", f"max({c}) - min({c})"),
    "robust": lambda c: (f"median({c})", f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def _scaled_sql(method: str) -> str:
    stats = ", ".join(f"{center} AS c_{c}, {scale} AS s_{c}" for c in SCALED for center, scale in [_STATS[method](f"CAST({c} AS DOUBLE)")])
    return rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, f"st AS (SELECT {stats} FROM model_input WHERE {_OLD})", body="SELECT application_id, " + ", ".join(
        f"(CAST({c} AS DOUBLE) - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in SCALED) + " FROM model_input, st"), SCALED)


def _scaled(method: str):
    def query(spark, sf):
        m = model_input(spark, sf)
        fitted = pp.Scaler(inputCols=SCALED, method=method).fit(before_last_year(m)[0])
        return finalize(fitted.transform(m).select("application_id", *SCALED))
    return query


for _method in pp.METHODS:
    register(f"d21_scale_{_method}", _scaled_sql(_method))(_scaled(_method))


# D22 -------------------------------------------------------------------------------
_LPS_SQL = f"""
lps AS (
SELECT *, CASE WHEN income * 1000 = 0 THEN NULL ELSE loan_amount / (income * 1000) END AS loan_to_income_ratio,
       CASE WHEN income * 1000 = 0 THEN NULL ELSE property_value / (income * 1000) END AS property_to_income_ratio,
       {bands_sql('CAST(credit_score AS DOUBLE)', fe.LPS_CREDIT)} AS credit_score_category,
       {bands_sql('income', fe.LPS_INCOME)} AS income_category, {bands_sql('loan_amount', fe.LPS_LOAN)} AS loan_amount_category,
       CAST(coalesce(loan_to_value_ratio > 90, FALSE) AS INT) AS high_ltv, CAST(coalesce(debt_to_income_ratio > 43, FALSE) AS INT) AS high_dti,
       CAST(coalesce(credit_score < 620, FALSE) AS INT) AS low_credit,
       {clip_sql("(850 - credit_score) / 550 * 40 + (CASE WHEN debt_to_income_ratio / 50 * 35 > 35 THEN 35.0 ELSE debt_to_income_ratio / 50 * 35 END) + (CASE WHEN (loan_to_value_ratio - 50) / 50 * 25 < 0 THEN 0.0 ELSE (loan_to_value_ratio - 50) / 50 * 25 END)", 0, 100)} AS risk_score
FROM model_input)"""
_DUMMIES = [(f"{c}_{k}", c, k) for c, labels in pp.BANDS.items() for k in labels[1:]]


@register("d22_transform_new_data", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, _LPS_SQL, f"""
st AS (SELECT {", ".join(f"avg(CAST({c} AS DOUBLE)) AS c_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in pp.SCALED)} FROM lps WHERE {_OLD})""",
    body="SELECT application_id, activity_year, " + ", ".join(f"(CAST({c} AS DOUBLE) - c_{c}) / s_{c} AS {c}" for c in pp.SCALED) + ", "
    + ", ".join(f"""CAST(coalesce({c} = '{k}', FALSE) AS INT) AS "{name}" """ for name, c, k in _DUMMIES)
    + f", high_ltv, high_dti, low_credit FROM lps, st WHERE NOT ({_OLD})"), pp.SCALED))
def d22(spark, sf):
    old, new = before_last_year(model_input(spark, sf))
    path = f"{ensure_checkpoint_dir(spark)}/preprocessor-{uuid.uuid4().hex}"
    save_model(pp.preprocessor().fit(old), path)
    return finalize(pp.transform_new_data(new, path))


# D23 -------------------------------------------------------------------------------
_D23 = ["income", "loan_amount", "property_value", "debt_to_income_ratio", "loan_to_value_ratio"]
_CAPPED = [*_D23, "loan_purpose", "loan_type", "occupancy_type", "loan_to_income_ratio", "down_payment_ratio"]


@register("d23_old_predictor_features", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, f"""
mid AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _D23)} FROM model_input)""", f"""
filled AS (SELECT application_id, m.action_taken, {", ".join(f"coalesce(m.{c}, m_{c}) AS {c}" for c in _D23)},
           CAST(loan_purpose AS DOUBLE) AS loan_purpose, CAST(loan_type AS DOUBLE) AS loan_type, CAST(occupancy_type AS DOUBLE) AS occupancy_type
           FROM model_input m JOIN applications USING (application_id), mid)""", f"""
ratios AS (SELECT *, loan_amount / greatest(income, 1) AS loan_to_income_ratio,
           {clip_sql("1 - loan_amount / greatest(property_value, 1)", -1, 1)} AS down_payment_ratio FROM filled)""", f"""
caps AS (SELECT {", ".join(f"quantile_cont({c}, 0.001) AS a_{c}, quantile_cont({c}, 0.999) AS b_{c}" for c in _CAPPED)} FROM ratios)""",
    body="SELECT application_id, " + ", ".join(f"CASE WHEN {c} < a_{c} THEN a_{c} WHEN {c} > b_{c} THEN b_{c} ELSE {c} END AS {c}" for c in _CAPPED)
    + ", CAST(action_taken IN (1, 2, 6, 8) AS INT) AS loan_approved, CAST(action_taken = 3 AS INT) AS loan_denied FROM ratios, caps"), _CAPPED))
def d23(spark, sf):
    codes = applications(spark, sf).select("application_id", "loan_purpose", "loan_type", "occupancy_type")
    return finalize(fe.old_predictor_features(model_input(spark, sf).join(codes, "application_id")).select(
        "application_id", *_CAPPED, "loan_approved", "loan_denied"))
