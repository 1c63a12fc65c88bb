"""Rule-based validation and cleaning.

``validate_dataframe`` rewrites every ruled column in one ``select`` and
computes every count of the report in one aggregate (single pass over the
data); the report is a small DataFrame of (column, severity, check, count,
message) rows.  Row-level application checks (B11, B12, B18) are column
expressions, so they also run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tractlens.functions import parse
from tractlens.functions.columns import null_d
from tractlens.functions.stats import exact_quantiles, materialize_small, quantile_row

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: rule sets per table type (B1).
RULES = {
    "hmda": {
        "loan_amount": {"min": 1000, "max": 10000000, "required": True, "type": "numeric"},
        "applicant_income": {"min": 0, "max": 10000000, "required": False, "type": "numeric"},
        "income": {"min": 0, "max": 10000000, "required": False, "type": "numeric"},
        "action_taken": {"min": 1, "max": 8, "required": True, "type": "integer"},
        "census_tract": {"required": True, "type": "string", "min_length": 3},
        "loan_type": {"min": 1, "max": 4, "required": False, "type": "integer"},
        "loan_purpose": {"min": 1, "max": 32, "required": False, "type": "integer"},
        "occupancy_type": {"min": 1, "max": 3, "required": False, "type": "integer"},
        "property_value": {"min": 1000, "max": 50000000, "required": False, "type": "numeric"},
        "debt_to_income_ratio": {"min": 0, "max": 100, "required": False, "type": "numeric"},
        "loan_to_value_ratio": {"min": 0, "max": 120, "required": False, "type": "numeric"},
        "applicant_credit_score_type": {"min": 300, "max": 850, "required": False, "type": "numeric"},
    },
    "gse": {
        "original_loan_amount": {"min": 1000, "max": 10000000, "required": True, "type": "numeric"},
        "original_interest_rate": {"min": 0.1, "max": 25.0, "required": True, "type": "numeric"},
        "ltv_ratio": {"min": 1, "max": 120, "required": False, "type": "numeric"},
        "dti_ratio": {"min": 0, "max": 100, "required": False, "type": "numeric"},
        "borrower_credit_score": {"min": 300, "max": 850, "required": False, "type": "numeric"},
        "census_tract": {"required": True, "type": "string", "min_length": 3},
        "loan_term": {"min": 1, "max": 50, "required": False, "type": "integer"},
    },
    "census": {
        "census_tract": {"required": True, "type": "string", "min_length": 3},
        "total_population": {"min": 0, "max": 100000, "required": False, "type": "integer"},
        "median_household_income": {"min": 0, "max": 1000000, "required": False, "type": "numeric"},
        "median_age": {"min": 0, "max": 100, "required": False, "type": "numeric"},
        "unemployment_rate": {"min": 0, "max": 50, "required": False, "type": "numeric"},
        "poverty_rate": {"min": 0, "max": 100, "required": False, "type": "numeric"},
        "education_bachelor_pct": {"min": 0, "max": 100, "required": False, "type": "numeric"},
        "homeownership_rate": {"min": 0, "max": 100, "required": False, "type": "numeric"},
    },
    "hpi": {
        "census_tract": {"required": True, "type": "string", "min_length": 3},
        "hpi_value": {"min": 1, "max": 10000, "required": True, "type": "numeric"},
        "year": {"min": 1990, "max": 2030, "required": True, "type": "integer"},
        "quarter": {"min": 1, "max": 4, "required": False, "type": "integer"},
        "month": {"min": 1, "max": 12, "required": False, "type": "integer"},
    },
    "unemployment": {
        "county_code": {"required": True, "type": "string", "min_length": 2},
        "unemployment_rate": {"min": 0, "max": 50, "required": True, "type": "numeric"},
        "year": {"min": 1990, "max": 2030, "required": True, "type": "integer"},
        "month": {"min": 1, "max": 12, "required": False, "type": "integer"},
    },
    "predictions": {
        "opportunity_score": {"min": 0, "max": 100, "required": True, "type": "numeric"},
        "predicted_opportunity_score": {"min": 0, "max": 100, "required": True, "type": "numeric"},
        "loan_volume": {"min": 0, "max": 100000, "required": False, "type": "integer"},
        "approval_rate": {"min": 0, "max": 1, "required": False, "type": "numeric"},
        "denial_rate": {"min": 0, "max": 1, "required": False, "type": "numeric"},
        "avg_loan_amount": {"min": 0, "max": 10000000, "required": False, "type": "numeric"},
    },
}
LOAN_RULES = {
    "loan_amount": {"min": 1000, "max": 5000000, "required": True, "type": "numeric"},
    "income": {"min": 1000, "max": 2000000, "required": True, "type": "numeric"},
    "property_value": {"min": 10000, "max": 20000000, "required": True, "type": "numeric"},
    "credit_score": {"min": 300, "max": 850, "required": True, "type": "numeric"},
    "debt_to_income_ratio": {"min": 0, "max": 100, "required": True, "type": "numeric"},
    "loan_to_value_ratio": {"min": 1, "max": 120, "required": True, "type": "numeric"},
    "employment_years": {"min": 0, "max": 50, "required": False, "type": "numeric"},
    "loan_term": {"min": 1, "max": 50, "required": False, "type": "integer"},
    "loan_type": {"min": 1, "max": 4, "required": False, "type": "integer"},
    "loan_purpose": {"min": 1, "max": 32, "required": False, "type": "integer"},
    "occupancy_type": {"min": 1, "max": 3, "required": False, "type": "integer"},
}
CODE_COLUMNS = ("census_tract", "county_code")
NAN_TEXTS = ("nan", "NaN", "None", "")
# Model-input checks of the loan predictor.
CRITICAL_COLUMNS = ["action_taken", "income", "loan_amount", "credit_score"]
IQR_COLUMNS = ["income", "loan_amount", "property_value", "credit_score"]
BUSINESS_RANGES = [("income", 10, 1000), ("credit_score", 300, 850),
                   ("debt_to_income_ratio", 0, 100), ("loan_to_value_ratio", 10, 100)]
# Service input checks (required fields, then dashboard limits).
INPUT_REQUIRED = ["income", "loan_amount", "property_value", "credit_score", "debt_to_income_ratio",
                  "loan_to_value_ratio"]
INPUT_LIMITS = [("income", 10, 1000), ("loan_amount", 10000, 5000000), ("property_value", 15000, 10000000),
                ("credit_score", 300, 850), ("debt_to_income_ratio", 0, 100), ("loan_to_value_ratio", 10, 100)]
# B14 recommendation texts.
REC_ERRORS = "❌ Critical data quality issues detected. Review and fix data sources."
REC_SANITIZE = "⚠️ High sanitization rate (>10%). Consider improving data collection processes."
REC_INCOME = "💰 Income data quality issues detected. Implement income validation at data source."
REC_RATIO = "📊 Ratio inconsistencies found. Implement cross-field validation."
REC_OK = "✅ Data quality looks good! Continue monitoring validation metrics."
# ---------------------------------------------------------------------------


def default_value(rule: dict):
    """numeric/integer -> min if min > 0 else 0; string -> 'Unknown'."""
    t = rule["type"]
    if t == "numeric":
        return float(rule["min"]) if rule.get("min", 0) > 0 else 0.0
    if t == "integer":
        return int(rule["min"]) if rule.get("min", 0) > 0 else 0
    if t == "string":
        return "Unknown"
    return None


def _num(c: Column) -> Column:
    # pd.to_numeric keeps +-inf, so only NaN-like text becomes null here.
    return c.cast("string").try_cast("double")


class _Check:
    def __init__(self, column: str, severity: str, check: str, cond: Column | None, template: str):
        self.column, self.severity, self.check, self.cond, self.template = column, severity, check, cond, template


class _Stager:
    """Collects intermediate columns level by level.  Each later step refers to
    a staged column instead of repeating the expression, so expression trees
    stay linear in the number of rules (no exponential when-chains)."""

    def __init__(self):
        self.levels: dict[int, list[tuple[str, Column]]] = {}

    def put(self, level: int, name: str, expr: Column) -> Column:
        self.levels.setdefault(level, []).append((name, expr))
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        for lvl in sorted(self.levels):
            df = df.withColumns(dict(self.levels[lvl]))
        return df

    def names(self) -> list[str]:
        return [n for lvl in self.levels.values() for n, _ in lvl]


def _column_rules(st: _Stager, column: str, rule: dict, strict: bool, numeric_input: bool = False):
    """Return (final column, checks, sanitized-count conditions, removal condition)."""
    orig = F.col(column)
    checks: list[_Check] = []
    sanitized: list[Column] = []
    remove = None
    d = default_value(rule)
    req = rule.get("required", False)
    p = f"_vr_{column}"
    # Numeric input columns skip the text round trip (nothing can fail to parse).
    typed = numeric_input and rule["type"] in ("numeric", "integer")
    cur = orig.cast("double") if typed else orig.cast("string")
    if req:
        if strict:
            remove = orig.isNull()
            checks.append(_Check(column, "error", "required_null", orig.isNull(),
                                 f"Column '{column}': {{n}} required values are null"))
        else:
            cur = F.coalesce(cur, F.lit(float(d) if typed else str(d)))
            checks.append(_Check(column, "warning", "null_filled", orig.isNull(),
                                 f"Column '{column}': {{n}} null values filled with {d}"))
            sanitized.append(orig.isNull())
    else:
        checks.append(_Check(column, "warning", "null_optional", orig.isNull(),
                             f"Column '{column}': {{n}} null values in optional field"))
    cur = st.put(1, f"{p}_s", cur)

    if rule["type"] in ("numeric", "integer"):
        x = cur if typed else st.put(2, f"{p}_x0", cur.try_cast("double"))
        conv = F.lit(False) if typed else (x.isNull() & cur.isNotNull())
        checks.append(_Check(column, "error", "not_numeric", conv,
                             f"Column '{column}': {{n}} values could not be converted to numeric"))
        if not strict:
            x = st.put(3, f"{p}_x1", F.when(conv, F.lit(float(d))).otherwise(x))
            sanitized.append(conv)
        if "min" in rule:
            below = x < F.lit(rule["min"])
            if strict:
                checks.append(_Check(column, "error", "below_min", below,
                                     f"Column '{column}': {{n}} values below minimum {rule['min']}"))
            else:
                sanitized.append(below)
                x = st.put(4, f"{p}_x2", F.when(below, F.lit(float(rule["min"]))).otherwise(x))
        if "max" in rule:
            above = x > F.lit(rule["max"])
            if strict:
                checks.append(_Check(column, "error", "above_max", above,
                                     f"Column '{column}': {{n}} values above maximum {rule['max']}"))
            else:
                sanitized.append(above)
                x = st.put(5, f"{p}_x3", F.when(above, F.lit(float(rule["max"]))).otherwise(x))
        inf = F.abs(x) == F.lit(float("inf"))
        checks.append(_Check(column, "error", "infinite", inf,
                             f"Column '{column}': {{n}} infinite values replaced with {d}"))
        sanitized.append(inf)
        x = st.put(6, f"{p}_x4", F.when(inf, F.lit(float(d))).otherwise(x))
        if rule["type"] == "integer":
            x = F.bround(x, 0).cast("int")  # pandas round = half to even (B7)
        return x.alias(column), checks, sanitized, remove

    if rule["type"] == "string":
        s = st.put(2, f"{p}_t0", F.when(cur.isNull(), F.lit("nan")).otherwise(cur))
        is_nan = s.isin(*NAN_TEXTS)
        sanitized.append(is_nan)
        s = st.put(3, f"{p}_t1", F.trim(F.when(is_nan, F.lit("000000" if column in CODE_COLUMNS else "Unknown"))
                                         .otherwise(s)))
        if "min_length" in rule:
            n = rule["min_length"]
            short = F.length(s) < n
            if strict:
                checks.append(_Check(column, "error", "too_short", short,
                                     f"Column '{column}': {{n}} values shorter than {n} characters"))
            else:
                sanitized.append(short)
                s = F.when(short, F.lpad(s, n, "0") if column in CODE_COLUMNS else F.lit("Unknown")).otherwise(s)
        return s.alias(column), checks, sanitized, remove
    return orig.alias(column), checks, sanitized, remove


def parse_ratios(df: DataFrame) -> DataFrame:
    """Ratio *texts* become numbers before any rule sees them.  DTI labels
    ('>60%', '20%-<30%', ...) are parsed, LTV texts lose their '%', 'Exempt' and
    the like become null; text that stays unreadable is left to B4."""
    out = df
    for c, number in (("debt_to_income_ratio", parse.dti_v2), ("loan_to_value_ratio", parse.ltv_percent)):
        if c in df.columns and isinstance(df.schema[c].dataType, StringType):
            t = F.trim(F.col(c))
            none = t.isin("nan", "NA", "", "Exempt") | (F.lower(t) == "exempt")
            out = out.withColumn(c, F.when(~none, F.coalesce(number(F.col(c)).cast("string"), F.col(c))))
    return out


def _plan(df: DataFrame, data_type: str, strict: bool):
    rules = RULES.get(data_type, {})
    cols = set(df.columns)
    st = _Stager()
    exprs: dict[str, Column] = {}
    checks: list[_Check] = []
    sanitized: list[Column] = []
    removes: list[Column] = []
    static: list[_Check] = []
    for column, rule in rules.items():
        if column not in cols:
            if rule.get("required", False):
                static.append(_Check(column, "error", "missing_column", None, f"Required column '{column}' missing"))
            else:
                static.append(_Check(column, "warning", "missing_column", None, f"Optional column '{column}' missing"))
            continue
        numeric_input = isinstance(df.schema[column].dataType, NumericType)
        e, ch, sa, rm = _column_rules(st, column, rule, strict, numeric_input)
        exprs[column] = e
        checks += ch
        sanitized += sa
        if rm is not None:
            removes.append(rm)
    removed = None
    for r in removes:
        removed = r if removed is None else (removed | r)
    return rules, st, exprs, checks, sanitized, removed, static


def _additional(clean_exprs: dict[str, Column], cols: set[str], data_type: str) -> list[_Check]:
    """B10 cross-field checks, on the sanitized values."""
    def c(name):
        return clean_exprs.get(name, F.col(name))
    out = []
    if data_type == "hmda":
        inc = "applicant_income" if "applicant_income" in cols else ("income" if "income" in cols else None)
        if "loan_amount" in cols and inc:
            ok = c(inc) > 0
            out.append(_Check("loan_amount", "warning", "lti_gt_10",
                              ok & (F.try_divide(c("loan_amount"), c(inc)) > 10),
                              "HMDA: {n} loans have unrealistic loan-to-income ratios (>10x)"))
        if "action_taken" in cols:
            out.append(_Check("action_taken", "error", "invalid_action",
                              ~F.coalesce(c("action_taken").isin(1, 2, 3, 4, 5, 6, 7, 8), F.lit(False)),
                              "HMDA: {n} invalid action_taken codes"))
    elif data_type == "gse":
        if "ltv_ratio" in cols and "dti_ratio" in cols:
            out.append(_Check("ltv_ratio", "warning", "high_risk", (c("ltv_ratio") > 95) & (c("dti_ratio") > 45),
                              "GSE: {n} loans have high risk profile (LTV>95% & DTI>45%)"))
    elif data_type == "predictions":
        if "opportunity_score" in cols:
            s = c("opportunity_score")
            out.append(_Check("opportunity_score", "warning", "extreme_score", (s < 10) | (s > 90),
                              "Predictions: {n} extreme opportunity scores (<10 or >90)"))
    return out


def clean_dataframe(df: DataFrame, data_type: str, strict: bool = False) -> DataFrame:
    """The sanitized (non-strict) or filtered (strict) table."""
    df = parse_ratios(df)
    rules, st, exprs, _, _, removed, _ = _plan(df, data_type, strict)
    if not rules:
        return df
    base = df if removed is None else df.filter(~removed)
    return st.apply(base).select(*[exprs.get(c, F.col(c)) for c in df.columns])


def validation_report(df: DataFrame, data_type: str, strict: bool = False) -> DataFrame:
    """B2 report: one row per issue (data_type, column, severity, check, count, message)
    plus a ``summary`` row holding rows processed / removed / sanitized and the status."""
    spark = df.sparkSession
    df = parse_ratios(df)
    rules, st, exprs, checks, sanitized, removed, static = _plan(df, data_type, strict)
    if not rules:
        return spark.createDataFrame(
            [(data_type, None, "info", "no_rules", 0, "no_rules")],
            "data_type string, column string, severity string, check string, count bigint, message string")
    keep = F.lit(True) if removed is None else ~removed
    extra = _additional({c: F.col(f"_vr_final_{c}") for c in exprs}, set(df.columns), data_type)
    aggs = [F.count(F.lit(1)).alias("rows_processed"),
            (F.count_if(removed) if removed is not None else F.lit(0)).alias("rows_removed"),
            (sum((F.count_if(s) for s in sanitized), F.lit(0)) if sanitized else F.lit(0)).alias("values_sanitized")]
    aggs += [F.count_if(ch.cond).alias(f"_c{i}") for i, ch in enumerate(checks)]
    aggs += [F.count_if(keep & ch.cond).alias(f"_x{i}") for i, ch in enumerate(extra)]
    staged = st.apply(df).withColumns({f"_vr_final_{c}": e for c, e in exprs.items()})
    one = staged.agg(*aggs)
    items = []
    for i, ch in enumerate(checks):
        items.append(F.struct(F.lit(ch.column).alias("column"), F.lit(ch.severity).alias("severity"),
                              F.lit(ch.check).alias("check"), F.col(f"_c{i}").cast("bigint").alias("count"),
                              F.lit(ch.template).alias("template")))
    for i, ch in enumerate(extra):
        items.append(F.struct(F.lit(ch.column).alias("column"), F.lit(ch.severity).alias("severity"),
                              F.lit(ch.check).alias("check"), F.col(f"_x{i}").cast("bigint").alias("count"),
                              F.lit(ch.template).alias("template")))
    for ch in static:
        items.append(F.struct(F.lit(ch.column).alias("column"), F.lit(ch.severity).alias("severity"),
                              F.lit(ch.check).alias("check"), F.lit(-1).cast("bigint").alias("count"),
                              F.lit(ch.template).alias("template")))
    issues = (one.select(F.explode(F.array(*items)).alias("it"), "rows_processed")
                 .select("it.*")
                 .filter((F.col("count") > 0) | (F.col("count") == -1))
                 .select(F.lit(data_type).alias("data_type"), "column", "severity", "check",
                         F.when(F.col("count") < 0, F.lit(None).cast("bigint")).otherwise(F.col("count")).alias("count"),
                         F.replace(F.col("template"), F.lit("{n}"), F.col("count").cast("string")).alias("message")))
    status = (issues.agg(F.count_if(F.col("severity") == "error").alias("ne"),
                         F.count_if(F.col("severity") == "warning").alias("nw")))
    summary = (one.crossJoin(status).select(
        F.lit(data_type).alias("data_type"), F.lit(None).cast("string").alias("column"),
        F.lit("info").alias("severity"), F.lit("summary").alias("check"),
        F.col("rows_processed").cast("bigint").alias("count"),
        F.format_string("status=%s rows_processed=%d rows_removed=%d values_sanitized=%d",
                        F.when(F.col("ne") > 0, "errors").when(F.col("nw") > 0, "warnings").otherwise("success"),
                        F.col("rows_processed"), F.col("rows_removed").cast("bigint"),
                        F.col("values_sanitized").cast("bigint")).alias("message")))
    return issues.unionByName(summary)


def validate_dataframe(df: DataFrame, data_type: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """B2: (clean table, report table) - both lazy."""
    return clean_dataframe(df, data_type, strict), validation_report(df, data_type, strict)


def validation_summary(reports: DataFrame) -> DataFrame:
    """B13 + B14 over the union of several reports: totals, status counts and the
    most common issue types (text before ':'), with recommendations."""
    summ = reports.filter(F.col("check") == "summary").select(
        "data_type", F.regexp_extract("message", r"status=(\w+)", 1).alias("status"),
        F.col("count").alias("rows_processed"),
        F.regexp_extract("message", r"values_sanitized=(\d+)", 1).cast("bigint").alias("values_sanitized"))
    tot = summ.agg(F.count(F.lit(1)).alias("total_datasets"),
                   F.count_if(F.col("status") == "success").alias("successful"),
                   F.count_if(F.col("status") == "warnings").alias("with_warnings"),
                   F.count_if(F.col("status") == "errors").alias("with_errors"),
                   F.sum("rows_processed").cast("bigint").alias("total_rows_processed"),
                   F.sum("values_sanitized").cast("bigint").alias("total_values_sanitized"))
    issues = reports.filter(F.col("check") != "summary")
    flags = issues.agg(
        F.count_if((F.col("severity") == "error") & F.lower("message").contains("income")
                   & F.lower("message").contains("missing")).alias("_inc"),
        F.count_if((F.col("severity") == "warning") & F.lower("message").contains("ratio")).alias("_ratio"))
    common = (issues.filter(F.col("severity") == "error")
                    .groupBy(F.split("message", ":").getItem(0).alias("issue_type")).count()
                    .agg(F.map_from_entries(F.collect_list(F.struct("issue_type", "count"))).alias("common_issues")))
    recs = F.array_compact(F.array(
        F.when(F.col("with_errors") > 0, F.lit(REC_ERRORS)),
        F.when(F.col("total_values_sanitized") > F.col("total_rows_processed") * 0.1, F.lit(REC_SANITIZE)),
        F.when(F.col("_inc") > 0, F.lit(REC_INCOME)),
        F.when(F.col("_ratio") > 0, F.lit(REC_RATIO))))
    return (tot.crossJoin(flags).crossJoin(common)
               .withColumn("recommendations", F.when(F.size(recs) == 0, F.array(F.lit(REC_OK))).otherwise(recs))
               .drop("_inc", "_ratio"))


# Batch application validation --------------------------------------
def validate_applications(df: DataFrame) -> DataFrame:
    """B11 + B12 re-aimed at a batch: per row sanitized fields, ``errors`` and
    ``warnings`` arrays, ``values_sanitized`` and ``status``."""
    cols = set(df.columns)
    errors, warns, san = [], [], []
    out = {}

    def fmt_num(x: Column) -> Column:
        return F.format_string("%s", x)

    for field, rule in LOAN_RULES.items():
        d = default_value(rule)
        if field not in cols:
            if rule.get("required"):
                errors.append(F.lit(f"Required field '{field}' missing"))
                san.append(F.lit(1))
                out[field] = F.lit(float(d) if rule["type"] == "numeric" else d)
            continue
        raw = F.col(field)
        v = raw.cast("string").try_cast("double")
        bad = v.isNull()
        kind = "numeric" if rule["type"] == "numeric" else "integer"
        errors.append(F.when(bad, F.lit(f"Field '{field}': Invalid {kind} value")))
        san.append(bad.cast("int"))
        if rule["type"] == "integer":
            v = F.when(bad, F.lit(float(d))).otherwise(v.cast("bigint").cast("double"))  # int(float(x))
        else:
            v = F.when(bad, F.lit(float(d))).otherwise(v)
        lo, hi = rule.get("min"), rule.get("max")
        if lo is not None:
            warns.append(F.when(v < lo, F.format_string(f"Field '{field}': Value %s below minimum {lo}", fmt_num(v))))
            san.append((v < lo).cast("int"))
            v = F.when(v < lo, F.lit(float(lo))).otherwise(v)
        if hi is not None:
            warns.append(F.when(v > hi, F.format_string(f"Field '{field}': Value %s above maximum {hi}", fmt_num(v))))
            san.append((v > hi).cast("int"))
            v = F.when(v > hi, F.lit(float(hi))).otherwise(v)
        out[field] = v.cast("int") if rule["type"] == "integer" else v
    res = df.select("*", *[e.alias(f"_s_{k}") for k, e in out.items()])
    for k in out:
        res = res.withColumn(k, F.col(f"_s_{k}")).drop(f"_s_{k}")
    # B12 ratio reconciliation on the sanitized values.
    la, inc, pv = F.col("loan_amount"), F.col("income"), F.col("property_value")
    lti = F.try_divide(la, inc)
    warns.append(F.when((inc > 0) & (lti > 8), F.format_string("Very high loan-to-income ratio: %.1fx", lti)))
    ltv_calc = F.try_divide(la, pv) * 100
    has_ltv = "loan_to_value_ratio" in cols or LOAN_RULES["loan_to_value_ratio"].get("required")
    mismatch = (pv > 0) & (F.abs(F.col("loan_to_value_ratio") - ltv_calc) > 5) if has_ltv else F.lit(False)
    warns.append(F.when(mismatch, F.lit("Inconsistent LTV ratio provided vs calculated")))
    dti = F.col("debt_to_income_ratio")
    warns.append(F.when(dti > 50, F.format_string("Very high DTI ratio: %s%%", dti))
                  .when(dti < 5, F.format_string("Unusually low DTI ratio: %s%%", dti)))
    res = res.withColumn("_err", F.array_compact(F.array(*errors))) \
             .withColumn("_warn", F.array_compact(F.array(*warns))) \
             .withColumn("values_sanitized", (sum(san, F.lit(0)) + mismatch.cast("int")).cast("int")) \
             .withColumn("loan_to_value_ratio", F.when(mismatch, ltv_calc).otherwise(F.col("loan_to_value_ratio")))
    return (res.withColumnRenamed("_err", "errors").withColumnRenamed("_warn", "warnings")
               .withColumn("status", F.when(F.size("errors") > 0, "errors")
                           .when(F.size("warnings") > 0, "warnings").otherwise("success")))


# Model-input cleaning ------------------------------------------------
def drop_incomplete(df: DataFrame, subset: Sequence[str] = CRITICAL_COLUMNS) -> DataFrame:
    """Drop rows with a null in any critical column."""
    return df.na.drop(subset=[c for c in subset if c in df.columns])


def iqr_filter(df: DataFrame, columns: Sequence[str] = IQR_COLUMNS) -> DataFrame:
    """Keep [Q1 - 1.5 IQR, Q3 + 1.5 IQR], one column after the other, each
    on the rows the previous step kept.  Quartiles are exact (linear) and
    computed by distributed rank selection; the one-row bounds are broadcast."""
    out = df
    for c in columns:
        if c not in out.columns:
            continue
        # One checkpointed row per step, so that no step plans the earlier ones' quartiles again.
        q = materialize_small(exact_quantiles(out, c, [0.25, 0.75]))
        b = q.select((F.col("q0") - (F.col("q1") - F.col("q0")) * 1.5).alias("_lo"),
                     (F.col("q1") + (F.col("q1") - F.col("q0")) * 1.5).alias("_hi"))
        out = (out.crossJoin(F.broadcast(b))
                  .filter((F.col(c) >= F.col("_lo")) & (F.col(c) <= F.col("_hi")))
                  .drop("_lo", "_hi"))
    return out


def business_range_filter(df: DataFrame) -> DataFrame:
    """Income 10-1000, score 300-850, DTI 0-100, LTV 10-100 (when present)."""
    out = df
    for c, lo, hi in BUSINESS_RANGES:
        if c in out.columns:
            out = out.filter((F.col(c) >= lo) & (F.col(c) <= hi))
    return out


def model_input_validation(df: DataFrame) -> DataFrame:
    """B15 -> B16 -> B17 in the reference's order."""
    return business_range_filter(iqr_filter(drop_incomplete(df)))


def input_check(df: DataFrame) -> DataFrame:
    """First failing check wins -> ``is_valid`` and ``error_message``."""
    cols = set(df.columns)
    msg = None
    for f in INPUT_REQUIRED:
        if f not in cols:
            cond, text = F.lit(True), F.lit(f"Missing required field: {f}")
        else:
            cond = F.col(f).isNull() | (F.col(f).cast("string") == "")
            text = F.lit(f"Field cannot be empty: {f}")
        msg = F.when(cond, text) if msg is None else msg.when(cond, text)
    for f, lo, hi in INPUT_LIMITS:
        if f in cols:
            v = F.col(f).cast("double")
            msg = msg.when((v < lo) | (v > hi), F.lit(f"{f} must be between {lo} and {hi}"))
    return df.withColumn("error_message", msg.otherwise(F.lit(""))) \
             .withColumn("is_valid", F.col("error_message") == "")


def profile(df: DataFrame, key_cols: Sequence[str] = ()) -> DataFrame:
    """Per column null count, distinct count and null %, as one row per column.

    Cells are unpivoted to (column, hash, length) and grouped with partial
    aggregation; the second aggregate then only counts.  Distinct values are told
    apart by a 64-bit hash and a second, independent one.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("empty"),
                               F.xxhash64(F.col(c)).alias("a"), F.hash(F.col(c)).alias("b")) for c in df.columns])
    seen = (df.select(F.explode(cells).alias("x")).select("x.*")
              .groupBy("column", "empty", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    per = seen.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).cast("bigint").alias("null_count"),
        F.count_if(~F.col("empty")).cast("bigint").alias("distinct_count"), F.sum("n").alias("_rows"))
    return per.select("column", "null_count", "distinct_count",
                      (F.lit(100.0) - F.col("null_count") / F.col("_rows") * 100).alias("pct_valid"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of exact duplicate rows (rows - distinct rows)."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    one = copies.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    return one.select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def winsorize(df: DataFrame, columns: Sequence[str], lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Clip each numeric column at its 0.1 % / 99.9 % linear quantiles
    (inf -> null first).  All columns' exact quantiles come from one plan."""
    out = df
    for c in columns:
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(F.abs(x) == float("inf"), null_d()).otherwise(x))
    q = quantile_row(out, {c: F.col(c) for c in columns}, [lo, hi])
    out = out.crossJoin(F.broadcast(q))
    for c in columns:
        x, a, b = F.col(c), F.col(f"{c}__q0"), F.col(f"{c}__q1")
        out = out.withColumn(c, F.when(x.isNull(), null_d()).when(x < a, a).when(x > b, b).otherwise(x))
    return out.drop(*q.columns)


def finite_fill(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Null / NaN / +-inf -> 0."""
    out = df
    for c in columns:
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(value))
                             .otherwise(x))
    return out
