"""Row-level decision rules.

All are column expressions (``when`` chains, array functions), so they run in
the same projection as scoring and also on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.functions.columns import code_map, non_null_array

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (HMDA code tables and texts).
ACTION_LABELS = {1: "Loan originated", 2: "Application approved but not accepted", 3: "Application denied",
                 4: "Application withdrawn by applicant", 5: "File closed for incompleteness", 6: "Purchased loan",
                 7: "Preapproval request denied", 8: "Preapproval request approved but not accepted"}
DENIAL_LABELS = {1: "Debt-to-income ratio", 2: "Employment history", 3: "Credit history", 4: "Collateral",
                 5: "Insufficient cash", 6: "Unverifiable information", 7: "Credit application incomplete",
                 8: "Mortgage insurance denied", 9: "Other", 10: "NA"}
UNKNOWN_REASON = "Unknown reason"
R_DTI_50 = "Debt-to-income ratio (exceeds 50%)"
R_DTI = "Debt-to-income ratio"
R_CREDIT = "Credit history"
R_CREDIT_MARGINAL = "Credit history (marginal score with high DTI)"
R_LTV = "Collateral (high loan-to-value ratio)"
R_LOAN_GT_VALUE = "Collateral (loan exceeds property value)"
R_CASH = "Insufficient cash (downpayment, closing costs)"
R_INCOME_LOW = "Employment history (insufficient income)"
R_INCOME_LTI = "Employment history (income insufficient for loan size)"
R_MULTI = "Other (multiple risk factors)"
R_DTI_CONSERVATIVE = "Debt-to-income ratio (exceeds conservative guidelines)"
R_OTHER = "Other"
WARNING_MARKERS = ["exceeds 50%", "extremely", "very high"]
REC_STRONG = "Strong approval candidate. Proceed with standard processing."
REC_GOOD = "Good approval candidate. Consider manual review for optimization."
REC_BORDER = "Borderline case. Detailed manual review recommended."
REC_DTI = "High DTI ratio - consider debt consolidation options"
REC_LTV = "High LTV ratio - larger down payment may improve approval chances"
REC_DEFAULT = "High risk application - consider alternative loan products"
# Form-text -> code maps.
CREDIT_BAND_SCORES = {"Excellent (800+)": 820, "Very Good (740-799)": 770, "Good (670-739)": 705,
                      "Fair (580-669)": 625, "Poor (<580)": 580}
CREDIT_BAND_DEFAULT = 700
# ---------------------------------------------------------------------------


def action_label(c: Column) -> Column:
    """C13."""
    return code_map(c, ACTION_LABELS, "Unknown action")


def denial_label(c: Column) -> Column:
    """Denial code -> text, unknown -> 'Unknown reason'."""
    return code_map(c, DENIAL_LABELS, UNKNOWN_REASON)


def add_missing_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add absent columns with literal defaults."""
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def rule_denial_reasons(dti: Column, ltv: Column, score: Column, income: Column, loan: Column,
                        value: Column) -> Column:
    """Ordered rules, fallback when none fires, at most 3 reasons.
    Missing inputs count as 0, as the reference's ``dict.get(..., 0)``."""
    d, l_, s = F.coalesce(dti, F.lit(0.0)), F.coalesce(ltv, F.lit(0.0)), F.coalesce(score, F.lit(0.0))
    inc, la, pv = F.coalesce(income, F.lit(0.0)), F.coalesce(loan, F.lit(0.0)), F.coalesce(value, F.lit(0.0))
    rules = non_null_array([
        F.when(d > 50, F.lit(R_DTI_50)).when(d > 43, F.lit(R_DTI)),
        F.when(s < 620, F.lit(R_CREDIT)).when((s < 680) & (d > 40), F.lit(R_CREDIT_MARGINAL)),
        F.when(l_ > 95, F.lit(R_LTV)).when((pv > 0) & (la > pv), F.lit(R_LOAN_GT_VALUE)),
        F.when((l_ > 90) & (d > 36), F.lit(R_CASH)).when(l_ > 97, F.lit(R_CASH)),
        F.when(inc < 30000, F.lit(R_INCOME_LOW))
         .when((inc > 0) & (la > 0) & (la / inc > 5), F.lit(R_INCOME_LTI)),
    ])
    risk = (d > 36).cast("int") + (l_ > 80).cast("int") + (s < 700).cast("int")
    rules = F.when((F.size(rules) == 0) & (risk >= 2), F.array(F.lit(R_MULTI))).otherwise(rules)
    fallback = (F.when(d > 28, F.lit(R_DTI_CONSERVATIVE)).when(l_ > 85, F.lit(R_CASH))
                 .when(s < 740, F.lit(R_CREDIT)).otherwise(F.lit(R_OTHER)))
    rules = F.when(F.size(rules) == 0, F.array(fallback)).otherwise(rules)
    return F.slice(rules, 1, 3)


def risk_warnings(reasons: Column, k: int = 2) -> Column:
    """Reasons that read as warnings for an approved application; first 2."""
    keep = F.filter(reasons, lambda r: F.lower(r).contains(WARNING_MARKERS[0]) | F.lower(r).contains(WARNING_MARKERS[1])
                    | F.lower(r).contains(WARNING_MARKERS[2]))
    return F.slice(keep, 1, k)


def _append_until(final: Column, extra: Column, limit: int = 3) -> Column:
    """final + [x for x in extra if x not in final], kept to ``limit`` entries."""
    fresh = F.filter(extra, lambda x: ~F.array_contains(final, x))
    return F.slice(F.concat(final, fresh), 1, limit)


def hybrid_reasons(rule_reasons: Column, model_reasons: Column, dti: Column, ltv: Column, score: Column) -> Column:
    """Combine rule and model reasons by case (extreme ratios, high
    ratios, low score, default); at most 3; falls back to rules, model, 'Other'."""
    d, l_, s = F.coalesce(dti, F.lit(0.0)), F.coalesce(ltv, F.lit(0.0)), F.coalesce(score, F.lit(0.0))
    ml = model_reasons
    rules = rule_reasons
    # Case A: extreme ratios - two rule reasons, then model reasons marked as confirmed.
    a_base = F.slice(rules, 1, 2)
    a = F.slice(F.concat(a_base, F.transform(F.filter(ml, lambda x: ~F.array_contains(a_base, x)),
                                             lambda x: F.concat(x, F.lit(" (ML confirmed)")))), 1, 3)
    # Case B: high ratios - first financial model reason, first dissimilar rule reason, more model reasons.
    fin_ml = F.slice(F.filter(ml, lambda r: F.lower(r).contains("debt") | F.lower(r).contains("collateral")
                              | F.lower(r).contains("cash")), 1, 1)
    words = F.filter(F.split(F.lower(F.concat_ws(" ", fin_ml)), " "), lambda w: w != "")
    dissimilar = F.slice(F.filter(rules, lambda r: ~F.exists(words, lambda w: F.lower(r).contains(w))), 1, 1)
    b = _append_until(F.concat(fin_ml, dissimilar), ml)
    # Case C: low score - credit reasons first.
    credit_ml = F.slice(F.filter(ml, lambda r: F.lower(r).contains("credit")), 1, 1)
    credit_rule = F.slice(F.filter(rules, lambda r: F.lower(r).contains("credit")), 1, 1)
    c_base = F.when(F.size(credit_ml) > 0, credit_ml).otherwise(credit_rule)
    other = F.concat(rules, F.filter(ml, lambda x: ~F.array_contains(c_base, x)))
    c = F.concat(c_base, F.slice(other, 1, 2))
    # Case D: two rule reasons then model reasons.
    dd = _append_until(F.slice(rules, 1, 2), ml)
    final = (F.when((d > 50) | (l_ > 95), a).when((d > 36) | (l_ > 85), b).when(s < 620, c).otherwise(dd))
    fallback = F.when(F.size(rules) > 0, rules).when(F.size(ml) > 0, ml).otherwise(F.array(F.lit(R_OTHER)))
    return F.slice(F.when(F.size(final) == 0, fallback).otherwise(final), 1, 3)


def probability_risk_level(p: Column) -> Column:
    """K14."""
    return F.when(p >= 0.8, "Low Risk").when(p >= 0.6, "Medium Risk").when(p >= 0.4, "High Risk") \
            .otherwise("Very High Risk")


def recommendation(p: Column, dti: Column, ltv_fraction: Column) -> Column:
    """Recommendation text; for low probability the DTI / LTV hints joined by '; '."""
    hints = non_null_array([F.when(F.coalesce(dti, F.lit(0.0)) > 43, F.lit(REC_DTI)),
                            F.when(F.coalesce(ltv_fraction, F.lit(0.0)) > 0.95, F.lit(REC_LTV))])
    low = F.when(F.size(hints) == 0, F.lit(REC_DEFAULT)).otherwise(F.concat_ws("; ", hints))
    return F.when(p >= 0.8, REC_STRONG).when(p >= 0.6, REC_GOOD).when(p >= 0.4, REC_BORDER).otherwise(low)


def denial_explanations(probs: Column, names: list[str], threshold: float = 0.5) -> Column:
    """Reasons whose probability exceeds 0.5, as formatted texts, and the primary (arg-max) reason."""
    items = F.array(*[F.struct(probs[i].alias("p"), F.lit(n).alias("reason")) for i, n in enumerate(names)])
    likely = F.filter(items, lambda x: x["p"] > threshold)
    texts = F.transform(likely, lambda x: F.format_string("%s (%.1f%% likelihood)", x["reason"], x["p"] * 100))
    primary = F.array_max(items)["reason"]
    return F.struct(texts.alias("likely_reasons"), primary.alias("primary_reason"))


def impact_level(importance: Column) -> Column:
    """> 0.15 High, > 0.08 Medium, else Low."""
    return F.when(importance > 0.15, "High").when(importance > 0.08, "Medium").otherwise("Low")


def probability_band(p_pct: Column) -> Column:
    """Probability >= 70 high, >= 40 medium."""
    return F.when(p_pct >= 70, "High").when(p_pct >= 40, "Medium").otherwise("Low")


def confidence_band(conf_pct: Column) -> Column:
    """Confidence >= 80 high, >= 60 medium."""
    return F.when(conf_pct >= 80, "High").when(conf_pct >= 60, "Medium").otherwise("Low")


def credit_band_score(text: Column) -> Column:
    """Credit band text -> representative score (default 700)."""
    return code_map(text, CREDIT_BAND_SCORES, CREDIT_BAND_DEFAULT)
