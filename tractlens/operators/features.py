"""Application-grain feature engineering.

Every function is ``DataFrame -> DataFrame`` built from column expressions
(no UDF), so the whole chain compiles into one projection per stage and also
runs unchanged on a streaming DataFrame (except the steps that need global
statistics: winsorizing, imputation and label encoding).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tractlens.functions import parse
from tractlens.functions.columns import bands, clip, code_map, nan_mean, null_d
from tractlens.functions.stats import materialize_small, quantile_row

INF = math.inf

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (bin edges, labels, weights).
INCOME_ADEQUACY = ([-INF, 3, 4, 5, INF], ["adequate", "moderate_risk", "high_risk", "very_high_risk"])
DOWN_PAYMENT_ADEQUACY = ([-INF, 0.05, 0.10, 0.20, INF], ["minimal", "low", "conventional", "substantial"])
DTI_RISK = ([-INF, 28, 36, 43, 50, INF], ["excellent", "good", "acceptable", "risky", "very_risky"])
LOAN_SIZE = ([-INF, 150000, 300000, 500000, 766550, INF], ["small", "medium", "large", "jumbo", "super_jumbo"])
FIN_RISK = ([-INF, 0.3, 0.5, 0.7, INF], ["low_risk", "moderate_risk", "high_risk", "very_high_risk"])
CREDIT_PROXY = ([0, 580, 620, 660, 720, 850], ["poor", "fair", "good", "very_good", "excellent"])
PURPOSE_SCORE = {1: 0.6, 2: 0.3, 3: 0.8}
PURPOSE_DEFAULT = 0.5
OCCUPANCY_SCORE = {1: 0.8, 2: 0.4}
OCCUPANCY_DEFAULT = 0.6
AGE_BANDS = ([0, 25, 35, 45, 55, 65, 100],
             ["young", "early_career", "mid_career", "late_career", "pre_retirement", "retirement"])
TRACT_INCOME = ([0, 80, 100, 120, INF], ["low_income_area", "moderate_income_area", "middle_income_area",
                                          "high_income_area"])
MINORITY = ([0, 10, 30, 50, 100], ["low_minority", "moderate_minority", "high_minority", "majority_minority"])
DENIAL_FLAGS = {1: "denial_debt_to_income", 2: "denial_employment_history", 3: "denial_credit_history",
                4: "denial_collateral", 5: "denial_insufficient_cash", 6: "denial_unverifiable_info",
                7: "denial_incomplete_application", 8: "denial_mortgage_insurance", 9: "denial_other",
                10: "denial_not_applicable"}
LOAN_TYPE_RISK = {1: "medium_risk", 2: "low_risk", 3: "low_risk", 4: "low_risk"}
RATE_BANDS = ([0, 3, 5, 7, 10, INF], ["very_low", "low", "moderate", "high", "very_high"])
SPREAD_BANDS = ([-INF, 0, 1.5, 3, INF], ["below_market", "at_market", "above_market", "high_cost"])
TERM_BANDS = ([0, 180, 360, 480, INF], ["short_term", "standard", "long_term", "very_long_term"])
DEMOGRAPHIC_COLUMNS = ["applicant_race-1", "applicant_ethnicity", "applicant_sex", "co-applicant_race-1",
                       "co-applicant_ethnicity", "co-applicant_sex"]
GEO_COLUMNS = ["state_code", "county_code", "census_tract", "derived_msa-md"]
# Loan-predictor features.
LPS_CREDIT = ([0, 580, 670, 740, 800, 850], ["Poor", "Fair", "Good", "Very Good", "Excellent"])
LPS_INCOME = ([0, 50, 100, 200, INF], ["Low", "Medium", "High", "Very High"])
LPS_LOAN = ([0, 200000, 400000, 750000, INF], ["Small", "Medium", "Large", "Jumbo"])
LPS_CURRENT_YEAR = 2025
# Risk tiers per factor (D25): (column, [(limit, label)...], fallback) - first limit the value meets.
RISK_TIERS = {
    "credit_risk": ("credit_score", "ge", [(740, "Low"), (670, "Medium"), (580, "High")], "Very High"),
    "dti_risk": ("debt_to_income_ratio", "le", [(28, "Low"), (36, "Medium"), (43, "High")], "Very High"),
    "ltv_risk": ("loan_to_value_ratio", "le", [(80, "Low"), (90, "Medium"), (95, "High")], "Very High"),
    "lti_risk": ("loan_to_income_ratio", "le", [(3, "Low"), (4, "Medium"), (5, "High")], "Very High"),
}
# ---------------------------------------------------------------------------


def _bands(c: Column, spec, include_lowest: bool = False) -> Column:
    return bands(c, spec[0], spec[1], include_lowest)


def target_variables(df: DataFrame) -> DataFrame:
    """C4/C5 as the feature engineer defines them."""
    a = F.col("action_taken")
    return df.withColumns({"loan_approved": parse.approved_broad(a), "loan_denied": parse.denied_broad(a),
                           "target": parse.model_target(a)})


def financial_features(df: DataFrame, winsorize_numeric: bool = True,
                       keep: Sequence[str] = ("application_id",)) -> DataFrame:
    """D1-D8 (+ the B21 clip of every numeric column that ends the step)."""
    inc = parse.to_number(F.col("income"))
    loan = parse.to_number(F.col("loan_amount"))
    out = df.withColumns({"income": inc, "loan_amount": loan})
    out = out.withColumn("actual_income", F.col("income") * 1000)
    ok = (F.col("income") > 0) & (F.col("loan_amount") > 0)
    out = out.withColumn("loan_to_income_ratio", F.when(ok, F.col("loan_amount") / F.col("actual_income")))
    out = out.withColumn("income_adequacy", _bands(F.col("loan_to_income_ratio"), INCOME_ADEQUACY))
    if "loan_term" in df.columns and "interest_rate" in df.columns:
        out = out.withColumns({"interest_rate": parse.to_number(F.col("interest_rate")),
                               "loan_term": parse.to_number(F.col("loan_term"))})
        rate_ok = (F.col("interest_rate") > 0) & (F.col("loan_term") > 0)
        r = F.col("interest_rate") / 100 / 12
        g = F.pow(F.lit(1.0) + r, F.col("loan_term"))
        out = out.withColumn("_g", F.when(rate_ok, g))
        den = F.col("_g") - 1
        out = out.withColumn("monthly_payment",
                             F.when(rate_ok & (den != 0), F.col("loan_amount") * (r * F.col("_g") / den)))
        out = out.withColumn("monthly_income", F.when(rate_ok, F.col("actual_income") / 12))
        out = out.withColumn("payment_to_income_ratio",
                             F.when(rate_ok & (F.col("monthly_income") > 0),
                                    F.col("monthly_payment") / F.col("monthly_income"))).drop("_g")
    if "property_value" in df.columns:
        out = out.withColumn("property_value", parse.to_number(F.col("property_value")))
        pv_ok = (F.col("property_value") > 0) & (F.col("loan_amount") > 0)
        out = out.withColumn("down_payment", F.when(pv_ok, F.col("property_value") - F.col("loan_amount")))
        out = out.withColumn("down_payment_ratio", F.when(pv_ok, F.col("down_payment") / F.col("property_value")))
        out = out.withColumn("loan_to_value_calculated",
                             F.when(pv_ok, F.col("loan_amount") / F.col("property_value")))
        out = out.withColumn("down_payment_adequacy", _bands(F.col("down_payment_ratio"), DOWN_PAYMENT_ADEQUACY))
    if "debt_to_income_ratio" in df.columns:
        out = out.withColumn("debt_to_income_ratio", parse.dti_v2(F.col("debt_to_income_ratio")))
        out = out.withColumn("dti_risk_category", _bands(F.col("debt_to_income_ratio"), DTI_RISK))
        compliant = F.coalesce((F.col("debt_to_income_ratio") <= 43), F.lit(False)).cast("int")
        out = out.withColumns({"dti_compliant": compliant, "dti_qm_compliant": compliant})
    out = out.withColumn("loan_size_category", _bands(F.col("loan_amount"), LOAN_SIZE))
    comps = []
    if "debt_to_income_ratio" in out.columns:
        comps.append(clip(F.col("debt_to_income_ratio") / 60, 0, 1))
    if "loan_to_value_calculated" in out.columns:
        comps.append(clip(F.col("loan_to_value_calculated"), 0, 1))
    comps.append(clip(F.col("loan_to_income_ratio") / 6, 0, 1))
    out = out.withColumn("financial_risk_score", nan_mean(comps))
    out = out.withColumn("financial_risk_category", _bands(F.col("financial_risk_score"), FIN_RISK))
    if winsorize_numeric:
        num = [f.name for f in out.schema.fields
               if isinstance(f.dataType, NumericType) and f.name not in set(keep)]
        out = winsorize_columns(out, num)
    return out


def winsorize_columns(df: DataFrame, columns: Sequence[str], lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """B21 for many columns with one quantile pass.  inf -> null first; each
    column clipped to its own exact linear quantiles (columns without values untouched).

    The frame is written to the checkpoint folder once: the quantiles' two passes, encoders fitted
    after it and the final write read it there, and none computes its long plan again.
    """
    if not columns:
        return df
    cleaned = materialize_small(df.withColumns({c: F.when(F.abs(F.col(c).cast("double")) == INF, null_d())
                                                    .otherwise(F.col(c).cast("double")) for c in columns}))
    q = quantile_row(cleaned, {c: F.col(c) for c in columns}, [lo, hi])
    bounds = q.select(*[F.col(f"{c}__q0").alias(f"_lo_{c}") for c in columns],
                      *[F.col(f"{c}__q1").alias(f"_hi_{c}") for c in columns])
    # Checkpointed once (one row), so later passes (encoder fit, final write)
    # reuse the bounds instead of recomputing the quantiles.
    out = cleaned.crossJoin(F.broadcast(materialize_small(bounds)))
    clipped = {}
    for c in columns:
        x, a, b = F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        clipped[c] = F.when(x.isNull() | a.isNull(), x).when(x < a, a).when(x > b, b).otherwise(x)
    return out.withColumns(clipped).drop(*[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns])


def credit_score_proxy(df: DataFrame) -> DataFrame:
    """300 + 550 x weighted indicators; null when a needed ratio is null."""
    parts = []
    if "debt_to_income_ratio" in df.columns:
        parts.append((F.lit(1.0) - clip(F.col("debt_to_income_ratio") / 60, 0, 1)) * 0.3)
    if "down_payment_ratio" in df.columns:
        parts.append(clip(F.col("down_payment_ratio") * 2, 0, 1) * 0.25)
    if "loan_to_income_ratio" in df.columns:
        parts.append((F.lit(1.0) - clip(F.col("loan_to_income_ratio") / 5, 0, 1)) * 0.25)
    if "loan_purpose" in df.columns:
        parts.append(code_map(F.col("loan_purpose"), PURPOSE_SCORE, PURPOSE_DEFAULT) * 0.1)
    if "occupancy_type" in df.columns:
        parts.append(code_map(F.col("occupancy_type"), OCCUPANCY_SCORE, OCCUPANCY_DEFAULT) * 0.1)
    if not parts:
        return df
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out = df.withColumn("credit_score_proxy", F.lit(300.0) + total * 550)
    return out.withColumn("credit_score_category", _bands(F.col("credit_score_proxy"), CREDIT_PROXY))


def label_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_encoded") -> DataFrame:
    """Sorted-text label codes (``LabelEncoder`` on ``astype(str)``).

    Uses MLlib ``StringIndexer(stringOrderType='alphabetAsc')``: its fit is a
    distributed count of the distinct values; only the label list (one entry
    per distinct value) reaches the driver.
    """
    from pyspark.ml.feature import StringIndexer

    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    tmp = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in present}
    staged = df.withColumns({f"_le_{c}": e for c, e in tmp.items()})
    idx = StringIndexer(inputCols=[f"_le_{c}" for c in present], outputCols=[f"_lei_{c}" for c in present],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    model = idx.fit(staged)
    out = model.transform(staged)
    # A value that the encoder hasn't seen (index = number of labels) gets code 0.
    seen = {c: len(labels) for c, labels in zip(present, model.labelsArray)}
    return (out.withColumns({f"{c}{suffix}": F.when(F.col(f"_lei_{c}") < seen[c], F.col(f"_lei_{c}")).otherwise(0).cast("int")
                             for c in present})
               .drop(*[f"_le_{c}" for c in present], *[f"_lei_{c}" for c in present]))


def demographic_features(df: DataFrame, encode: bool = True) -> DataFrame:
    """D10 (demographics) + D11 age bands and joint-application flag."""
    out = label_encode(df, DEMOGRAPHIC_COLUMNS) if encode else df
    if "applicant_age" in df.columns:
        out = out.withColumn("applicant_age_category", _bands(parse.to_number(F.col("applicant_age")), AGE_BANDS))
    if "co-applicant_sex" in df.columns:
        out = out.withColumn("joint_application",
                             F.coalesce(F.col("`co-applicant_sex`").cast("string") != "5", F.lit(True)).cast("int"))
    return out


def geographic_features(df: DataFrame, encode: bool = True) -> DataFrame:
    """D10 (geography) + D12 tract income and minority bands (0 falls outside)."""
    out = label_encode(df, GEO_COLUMNS) if encode else df
    if "tract_to_msa_income_percentage" in df.columns:
        out = out.withColumn("tract_income_category",
                             _bands(F.col("tract_to_msa_income_percentage").cast("double"), TRACT_INCOME))
    if "tract_minority_population_percent" in df.columns:
        out = out.withColumn("minority_concentration",
                             _bands(F.col("tract_minority_population_percent").cast("double"), MINORITY))
    return out


def denial_reason_features(df: DataFrame) -> DataFrame:
    """Count of codes > 0 across every ``denial_reason*`` column, a flag,
    and one 'any column equals k' indicator per code."""
    cols = [c for c in df.columns if "denial_reason" in c.lower()]
    if not cols:
        return df
    out = df.withColumns({c: F.coalesce(parse.to_number(F.col(f"`{c}`")), F.lit(0.0)) for c in cols})
    arr = F.array(*[F.col(f"`{c}`") for c in cols])
    out = out.withColumn("num_denial_reasons", F.size(F.filter(arr, lambda x: x > 0)).cast("int"))
    out = out.withColumn("has_denial_reason", (F.col("num_denial_reasons") > 0).cast("int"))
    return out.withColumns({name: F.array_contains(arr, float(code)).cast("int")
                            for code, name in DENIAL_FLAGS.items()})


def loan_product_features(df: DataFrame) -> DataFrame:
    """D14 + LTV parser v2 (fraction)."""
    out = df
    if "loan_type" in df.columns:
        lt = parse.to_number(F.col("loan_type"))
        out = out.withColumn("loan_type", lt).withColumn(
            "loan_type_risk", F.coalesce(code_map(F.col("loan_type"), LOAN_TYPE_RISK), F.lit("unknown")))
    if "interest_rate" in df.columns:
        out = out.withColumn("interest_rate", parse.to_number(F.col("interest_rate")))
        out = out.withColumn("interest_rate_category", _bands(F.col("interest_rate"), RATE_BANDS))
    if "rate_spread" in df.columns:
        out = out.withColumn("rate_spread", parse.to_number(F.col("rate_spread")))
        out = out.withColumn("rate_spread_category", _bands(F.col("rate_spread"), SPREAD_BANDS))
    if "loan_term" in df.columns:
        out = out.withColumn("loan_term", parse.to_number(F.col("loan_term")))
        out = out.withColumn("loan_term_category", _bands(F.col("loan_term"), TERM_BANDS))
    if "loan_to_value_ratio" in df.columns:
        out = out.withColumn("loan_to_value_ratio", parse.ltv_v2(F.col("loan_to_value_ratio")))
    return out


def engineer_all_features(df: DataFrame, winsorize_numeric: bool = True, encode: bool = True) -> DataFrame:
    """Target -> financial -> credit -> demographic -> geographic -> denial -> product.

    The demographic and geographic label encoders are fitted together (one
    pass over the data) before the band features are added."""
    out = (df.transform(target_variables)
             .transform(lambda d: financial_features(d, winsorize_numeric))
             .transform(credit_score_proxy))
    if encode:
        out = label_encode(out, DEMOGRAPHIC_COLUMNS + GEO_COLUMNS)
    return (out.transform(lambda d: demographic_features(d, encode=False))
               .transform(lambda d: geographic_features(d, encode=False))
               .transform(denial_reason_features)
               .transform(loan_product_features))


CORE_FEATURES = ["debt_to_income_ratio", "loan_to_value_calculated", "loan_to_income_ratio", "down_payment_ratio",
                 "credit_score_proxy", "financial_risk_score", "monthly_payment", "payment_to_income_ratio",
                 "age_category", "applicant_race_encoded", "applicant_sex_encoded", "dti_risk_category_encoded",
                 "ltv_risk_category_encoded", "loan_size_category_encoded", "income_category_encoded",
                 "credit_score_category_encoded", "financial_risk_category_encoded"]
NOT_ENCODED = ["action_taken", "target", "loan_approved", "loan_denied"]


def prepare_for_modeling(df: DataFrame, keys: Sequence[str] = ("application_id",)) -> tuple[DataFrame, list[str]]:
    """The core features that exist, without gaps (B20), and every other text column
    as label codes (D10).  Returns the frame and the feature names."""
    present = [c for c in CORE_FEATURES if c in df.columns]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)
             and f.name not in NOT_ENCODED and f.name not in set(keys)]
    others = [c for c in df.columns if c not in present]
    filled = impute_for_model(df, keys=others)
    out = label_encode(filled, texts) if texts else filled
    return out, present + [f"{c}_encoded" for c in texts]


# Loan-predictor features ------------------------------------------------------
def lps_features(df: DataFrame) -> DataFrame:
    """D18 + D19: ratios, bands, loan age, flags and the composite risk score."""
    inc = F.col("income") * 1000
    out = df.withColumns({
        "loan_to_income_ratio": F.try_divide(F.col("loan_amount").cast("double"), inc),
        "property_to_income_ratio": F.try_divide(F.col("property_value").cast("double"), inc),
        "credit_score_category": _bands(F.col("credit_score").cast("double"), LPS_CREDIT),
        "income_category": _bands(F.col("income").cast("double"), LPS_INCOME),
        "loan_amount_category": _bands(F.col("loan_amount").cast("double"), LPS_LOAN),
        "loan_age_years": F.lit(LPS_CURRENT_YEAR) - F.col("activity_year"),
        "high_ltv": F.coalesce(F.col("loan_to_value_ratio") > 90, F.lit(False)).cast("int"),
        "high_dti": F.coalesce(F.col("debt_to_income_ratio") > 43, F.lit(False)).cast("int"),
        "low_credit": F.coalesce(F.col("credit_score") < 620, F.lit(False)).cast("int"),
    })
    return out.withColumn("risk_score", lps_risk_score(F.col("credit_score"), F.col("debt_to_income_ratio"),
                                                       F.col("loan_to_value_ratio")))


def lps_risk_score(score: Column, dti: Column, ltv: Column) -> Column:
    """Credit 40 + DTI 35 (capped) + LTV 25 (floored at 0), clipped 0..100; null-propagating."""
    credit = (F.lit(850) - score) / 550 * 40
    d = dti / 50 * 35
    d = F.when(d.isNull(), null_d()).when(d > 35, F.lit(35.0)).otherwise(d)
    l_ = (ltv - 50) / 50 * 25
    l_ = F.when(l_.isNull(), null_d()).when(l_ < 0, F.lit(0.0)).otherwise(l_)
    return clip(credit + d + l_, 0, 100)


# Fixed values that must equal the reference: the old predictor's columns.
OLD_NUMERIC = ["loan_amount", "income", "debt_to_income_ratio", "loan_to_value_ratio", "property_value", "applicant_credit_score_type"]
OLD_CATEGORICAL = ["loan_type", "loan_purpose", "occupancy_type", "derived_loan_product_type", "derived_dwelling_category",
                   "derived_ethnicity", "derived_race", "derived_sex", "lien_status"]


def old_predictor_features(df: DataFrame, keys: Sequence[str] = ("application_id",)) -> DataFrame:
    """Amounts filled with their median, text categories with 'Unknown'; loan to income and
    down payment over at least 1, the latter within -1..1; then infinities become the column's median, and
    every number is held between its 0.1 % and 99.9 % quantiles (B21).  Adds both outcome flags."""
    numeric = [c for c in OLD_NUMERIC if c in df.columns]
    texts = [f.name for f in df.schema.fields if f.name in OLD_CATEGORICAL and isinstance(f.dataType, StringType)]
    codes = [c for c in OLD_CATEGORICAL if c in df.columns and c not in texts]
    real = df.withColumns({c: parse.to_number(F.col(c)) for c in numeric} | {c: F.col(c).cast("double") for c in codes}
                          | {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in texts})
    middle = materialize_small(quantile_row(real, {c: F.col(c) for c in numeric}, [0.5]))
    out = real.crossJoin(F.broadcast(middle)).withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__q0")) for c in numeric}).drop(*middle.columns)
    made = []
    if {"loan_amount", "income"} <= set(numeric):
        out = out.withColumn("loan_to_income_ratio", F.col("loan_amount") / F.greatest(F.col("income"), F.lit(1.0)))
        made.append("loan_to_income_ratio")
    if {"loan_amount", "property_value"} <= set(numeric):
        out = out.withColumn("down_payment_ratio", clip(F.lit(1.0) - F.col("loan_amount") / F.greatest(F.col("property_value"), F.lit(1.0)), -1, 1))
        made.append("down_payment_ratio")
    if "action_taken" in df.columns:
        a = F.col("action_taken")
        out = out.withColumns({"loan_approved": parse.approved_broad(a), "loan_denied": (a == 3).cast("int")})
    held = [c for c in [*numeric, *codes, *made] if c not in set(keys)]
    finite = {c: F.when(F.abs(F.col(c)) < INF, F.col(c)) for c in held}
    again = materialize_small(quantile_row(out, finite, [0.5]))
    out = out.crossJoin(F.broadcast(again)).withColumns({c: F.coalesce(x, F.col(f"{c}__q0")) for c, x in finite.items()}).drop(*again.columns)
    return winsorize_columns(out, held)


def one_hot_drop_first(df: DataFrame, column: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """``get_dummies(drop_first=True)`` with a frozen category list: the first
    category is dropped, absent categories give 0 columns."""
    p = prefix or column
    c = F.col(column).cast("string")
    return df.withColumns({f"{p}_{k}": F.coalesce((c == F.lit(k)), F.lit(False)).cast("int")
                           for k in list(categories)[1:]})


def risk_tiers(df: DataFrame) -> DataFrame:
    """Per-factor risk tier as a struct column ``risk_factors``."""
    fields = []
    for name, (col, op, limits, fallback) in RISK_TIERS.items():
        if col not in df.columns:
            continue
        x = F.col(col)
        e = None
        for lim, label in limits:
            cond = (x >= lim) if op == "ge" else (x <= lim)
            e = F.when(cond, label) if e is None else e.when(cond, label)
        fields.append(F.when(x.isNull(), F.lit(None).cast("string")).otherwise(e.otherwise(fallback)).alias(name))
    return df.withColumn("risk_factors", F.struct(*fields))


def clustering_features(df: DataFrame) -> DataFrame:
    """Tract-level ratios for segmentation."""
    return df.withColumns({
        "loan_to_income": F.try_divide(F.col("avg_loan_amount"), F.col("median_household_income") + 1),
        "approval_denial_ratio": F.try_divide(F.col("approval_rate"), F.col("denial_rate") + 0.01),
        "loans_per_capita": F.try_divide(F.col("loan_count").cast("double"), F.col("total_population") + 1) * 1000,
    })


def impute_for_model(df: DataFrame, amount_defaults: dict[str, float] | None = None,
                     categoricals: Sequence[str] = (), keys: Sequence[str] = ("application_id", "activity_year")) -> DataFrame:
    """+-inf -> the 99 % / 1 % quantile of the column's finite values; then the
    median for the named amounts (fallback constants when no median), the mode
    (smallest of the most frequent) for the other numerics, then 0; categoricals ->
    'Unknown'.  Key columns stay as they are.

    Quantiles and modes come from value counts (see ``functions.stats``), so no task
    holds a column; the one-row results are broadcast.
    """
    amount_defaults = amount_defaults or {"income": 75.0, "loan_amount": 200000.0, "property_value": 250000.0}
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in set(keys)]
    out = df
    if num:
        real = {c: F.col(f"`{c}`").cast("double") for c in num}
        finite = {c: F.when(F.abs(x) != INF, x) for c, x in real.items()}
        cells = F.array(*[F.struct(F.lit(c).alias("c"), x.alias("v")) for c, x in finite.items()])
        counts = (df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
                    .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
        modes = counts.groupBy("c").agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias("mode")).agg(
            *[F.max(F.when(F.col("c") == c, F.col("mode"))).alias(f"_o_{c}") for c in num])
        st = quantile_row(df, finite, [0.01, 0.5, 0.99]).crossJoin(modes)
        out = df.crossJoin(F.broadcast(st))
        fills = {}
        for c in num:
            x = F.when(real[c] == INF, F.col(f"`{c}__q2`")).when(real[c] == -INF, F.col(f"`{c}__q0`")).otherwise(
                F.nanvl(real[c], null_d()))
            fill = (F.coalesce(F.col(f"`{c}__q1`"), F.lit(float(amount_defaults[c]))) if c in amount_defaults
                    else F.coalesce(F.col(f"`_o_{c}`"), F.lit(0.0)))
            fills[c] = F.coalesce(x, fill).cast(df.schema[c].dataType)
        out = out.withColumns(fills).drop(*st.columns)
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
                            for c in categoricals if c in df.columns})


# Prediction-time feature variant -------------------------------------------
PRED_DEFAULTS = {"debt_to_income_ratio": 30.0, "loan_to_value_ratio": 80.0, "property_value": 300000,
                 "loan_amount": 250000, "income": 75, "interest_rate": 6.5, "loan_term": 360, "applicant_age": 35,
                 "applicant_race-1": 5, "applicant_sex": 1, "county_code": 20091, "census_tract": 20091001400}
PRED_DTI = ([0, 20, 28, 36, 45, 100], ["Excellent", "Good", "Acceptable", "High", "Very High"])
PRED_LTV = ([0, 80, 90, 95, 100], ["Low", "Medium", "High", "Very High"])
PRED_SIZE = ([0, 200000, 400000, 600000, 1000000, INF], ["Small", "Medium", "Large", "Jumbo", "Super Jumbo"])
PRED_INCOME = ([0, 50000, 75000, 100000, 150000, INF], ["Low", "Lower Middle", "Middle", "Upper Middle", "High"])
PRED_CREDIT = ([300, 580, 670, 740, 800, 850], ["Poor", "Fair", "Good", "Very Good", "Excellent"])
PRED_RISK = ([0, 25, 50, 75, 100], ["Low", "Medium", "High", "Very High"])
PRED_AGE = ([0, 25, 35, 45, 55, 65, 100], ["1", "2", "3", "4", "5", "6"])
PRED_STEPS = {"debt_to_income_ratio": [(43, 100), (36, 50), (28, 25)],
              "loan_to_value_calculated": [(95, 75), (90, 50), (80, 25)],
              "loan_to_income_ratio": [(5, 100), (4, 50), (3, 25)]}
PRED_FEATURES = ["debt_to_income_ratio", "loan_to_value_calculated", "loan_to_income_ratio", "down_payment_ratio",
                 "credit_score_proxy", "financial_risk_score", "monthly_payment", "payment_to_income_ratio",
                 "age_category", "applicant_race_encoded", "applicant_sex_encoded"]
PRED_CATEGORIES = {"dti_risk_category": PRED_DTI, "ltv_risk_category": PRED_LTV, "loan_size_category": PRED_SIZE,
                   "income_category": PRED_INCOME, "credit_score_category": PRED_CREDIT,
                   "financial_risk_category": PRED_RISK}


def prediction_features(df: DataFrame, keep: Sequence[str] = ("application_id",)) -> DataFrame:
    """The prediction-time variant (LTV in percent, stepwise credit proxy,
    0-100 risk score, fixed-vocabulary label codes).  Ratio texts are parsed first; a
    row whose category is outside the vocabulary gets the middle code, and no row
    depends on another, so the step also streams."""
    from tractlens.functions.columns import clip as _clip

    out = df.withColumns({c: F.lit(v) for c, v in PRED_DEFAULTS.items() if c not in df.columns})
    num = ["debt_to_income_ratio", "loan_to_value_ratio", "property_value", "loan_amount", "income",
           "interest_rate", "loan_term", "applicant_age"]
    special = {"debt_to_income_ratio": parse.dti_v2, "loan_to_value_ratio": parse.ltv_percent}
    out = out.withColumns({c: special.get(c, parse.to_number)(F.col(c)) for c in num})
    out = out.withColumn("actual_income", F.col("income") * 1000)
    ok = (F.col("income") > 0) & (F.col("loan_amount") > 0)
    out = out.withColumn("loan_to_income_ratio",
                         F.coalesce(F.when(ok, F.col("loan_amount") / F.col("actual_income")), F.lit(0.0)))
    pv_ok = (F.col("property_value") > 0) & (F.col("loan_amount") > 0)
    out = out.withColumn("loan_to_value_calculated",
                         F.coalesce(F.when(pv_ok, F.col("loan_amount") / F.col("property_value") * 100), F.lit(80.0)))
    out = out.withColumns({
        "down_payment_amount": F.col("property_value") * (F.lit(1.0) - F.col("loan_to_value_calculated") / 100),
        "down_payment_ratio": F.lit(100.0) - F.col("loan_to_value_calculated")})
    txt = {"dti_risk_category": "debt_to_income_ratio", "ltv_risk_category": "loan_to_value_calculated",
           "loan_size_category": "loan_amount", "income_category": "actual_income"}
    out = out.withColumns({k: F.coalesce(bands(F.col(v), *PRED_CATEGORIES[k], include_lowest=True), F.lit("nan"))
                           for k, v in txt.items()})
    proxy = F.lit(850.0)
    for col, steps in PRED_STEPS.items():
        x = F.col(col)
        ded = F.when(x > steps[0][0], steps[0][1]).when(x > steps[1][0], steps[1][1]) \
               .when(x > steps[2][0], steps[2][1]).otherwise(0)
        proxy = proxy - ded
    out = out.withColumn("credit_score_proxy", _clip(proxy, 300, 850))
    out = out.withColumn("credit_score_category",
                         F.coalesce(bands(F.col("credit_score_proxy"), *PRED_CREDIT, include_lowest=True), F.lit("nan")))
    risk = (_clip(F.col("debt_to_income_ratio") * 2, 0, 100) * 0.4
            + _clip(F.col("loan_to_value_calculated") * 1.2, 0, 100) * 0.35
            + _clip(F.col("loan_to_income_ratio") * 20, 0, 100) * 0.25)
    out = out.withColumn("financial_risk_score", _clip(risk, 0, 100))
    out = out.withColumn("financial_risk_category",
                         F.coalesce(bands(F.col("financial_risk_score"), *PRED_RISK, include_lowest=True), F.lit("nan")))
    r = F.col("interest_rate") / 100 / 12
    g = F.pow(F.lit(1.0) + r, F.col("loan_term"))
    out = out.withColumn("monthly_payment", F.col("loan_amount") * F.try_divide(r * g, g - 1))
    out = out.withColumn("payment_to_income_ratio",
                         F.try_divide(F.col("monthly_payment"), F.col("actual_income") / 12) * 100)
    out = out.withColumn("age_category",
                         bands(F.col("applicant_age"), *PRED_AGE, include_lowest=True).cast("double"))
    out = out.withColumns({"applicant_race_encoded": parse.to_number(F.col("`applicant_race-1`")),
                           "applicant_sex_encoded": parse.to_number(F.col("applicant_sex"))})
    # Fixed-vocabulary codes: sorted labels -> 0..n-1; any other label -> n // 2.
    enc = {}
    for c, (_, labs) in PRED_CATEGORIES.items():
        codes = {lab: i for i, lab in enumerate(sorted(labs))}
        enc[f"{c}_encoded"] = code_map(F.col(c), codes, len(labs) // 2)
    out = out.withColumns(enc)
    feats = PRED_FEATURES + list(enc)
    finite = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                        | (F.abs(F.col(c).cast("double")) == INF), F.lit(0.0)).otherwise(F.col(c).cast("double"))
              for c in feats}
    return out.withColumns(finite).select(*[k for k in keep if k in df.columns], *feats)
