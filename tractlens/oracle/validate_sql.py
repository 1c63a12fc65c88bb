"""DuckDB oracle for rule validation: an independent SQL rendering of the
rules in ``tractlens.operators.validate``."""

from __future__ import annotations

from tractlens.operators.validate import CODE_COLUMNS, RULES, default_value


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v)) if isinstance(v, float) else str(v)


def _column_sql(col: str, rule: dict, strict: bool):
    """(value expression, [(severity, check, condition, template)], [sanitize conditions])."""
    d = default_value(rule)
    checks, san = [], []
    cur = f"CAST({col} AS VARCHAR)"
    if rule.get("required"):
        if strict:
            checks.append(("error", "required_null", f"{col} IS NULL",
                           f"Column '{col}': {{n}} required values are null"))
        else:
            cur = f"coalesce({cur}, {_lit(str(d))})"
            checks.append(("warning", "null_filled", f"{col} IS NULL",
                           f"Column '{col}': {{n}} null values filled with {d}"))
            san.append(f"{col} IS NULL")
    else:
        checks.append(("warning", "null_optional", f"{col} IS NULL",
                       f"Column '{col}': {{n}} null values in optional field"))
    if rule["type"] in ("numeric", "integer"):
        x = f"TRY_CAST({cur} AS DOUBLE)"
        conv = f"({x} IS NULL AND {cur} IS NOT NULL)"
        checks.append(("error", "not_numeric", conv, f"Column '{col}': {{n}} values could not be converted to numeric"))
        if not strict:
            x = f"(CASE WHEN {conv} THEN {float(d)!r} ELSE {x} END)"
            san.append(conv)
        if "min" in rule:
            below = f"({x} < {rule['min']})"
            if strict:
                checks.append(("error", "below_min", below, f"Column '{col}': {{n}} values below minimum {rule['min']}"))
            else:
                san.append(below)
                x = f"(CASE WHEN {below} THEN {float(rule['min'])!r} ELSE {x} END)"
        if "max" in rule:
            above = f"({x} > {rule['max']})"
            if strict:
                checks.append(("error", "above_max", above, f"Column '{col}': {{n}} values above maximum {rule['max']}"))
            else:
                san.append(above)
                x = f"(CASE WHEN {above} THEN {float(rule['max'])!r} ELSE {x} END)"
        inf = f"(abs({x}) = 'inf'::DOUBLE)"
        checks.append(("error", "infinite", inf, f"Column '{col}': {{n}} infinite values replaced with {d}"))
        san.append(inf)
        x = f"(CASE WHEN {inf} THEN {float(d)!r} ELSE {x} END)"
        if rule["type"] == "integer":
            x = f"CAST(round_even({x}, 0) AS INTEGER)"
        return x, checks, san
    s = f"coalesce({cur}, 'nan')"
    is_nan = f"({s} IN ('nan', 'NaN', 'None', ''))"
    san.append(is_nan)
    s = f"trim(CASE WHEN {is_nan} THEN {_lit('000000' if col in CODE_COLUMNS else 'Unknown')} ELSE {s} END)"
    if "min_length" in rule:
        n = rule["min_length"]
        short = f"(length({s}) < {n})"
        if strict:
            checks.append(("error", "too_short", short, f"Column '{col}': {{n}} values shorter than {n} characters"))
        else:
            san.append(short)
            pad = f"lpad({s}, {n}, '0')" if col in CODE_COLUMNS else "'Unknown'"
            s = f"(CASE WHEN {short} THEN {pad} ELSE {s} END)"
    return s, checks, san


def clean_sql(source: str, columns: list[str], data_type: str, strict: bool) -> str:
    rules = RULES[data_type]
    sel, removes = [], []
    for c in columns:
        if c in rules:
            e, _, _ = _column_sql(c, rules[c], strict)
            sel.append(f"{e} AS {c}")
            if strict and rules[c].get("required"):
                removes.append(f"{c} IS NULL")
        else:
            sel.append(c)
    where = f" WHERE NOT ({' OR '.join(removes)})" if removes else ""
    return f"SELECT {', '.join(sel)} FROM {source}{where}"


def report_sql(source: str, columns: list[str], data_type: str, strict: bool) -> str:
    rules = RULES[data_type]
    cols = set(columns)
    checks, san, removes, static, clean = [], [], [], [], {}
    for c, rule in rules.items():
        if c not in cols:
            sev = "error" if rule.get("required") else "warning"
            kind = "Required" if rule.get("required") else "Optional"
            static.append((c, sev, "missing_column", f"{kind} column '{c}' missing"))
            continue
        e, ch, sa = _column_sql(c, rule, strict)
        clean[c] = e
        checks += [(c,) + x for x in ch]
        san += sa
        if strict and rule.get("required"):
            removes.append(f"{c} IS NULL")
    keep = f"NOT ({' OR '.join(removes)})" if removes else "TRUE"
    extra = []
    if data_type == "hmda":
        inc = "applicant_income" if "applicant_income" in cols else ("income" if "income" in cols else None)
        if "loan_amount" in cols and inc:
            extra.append(("loan_amount", "warning", "lti_gt_10",
                          f"({clean[inc]} > 0 AND {clean['loan_amount']} / {clean[inc]} > 10)",
                          "HMDA: {n} loans have unrealistic loan-to-income ratios (>10x)"))
        if "action_taken" in cols:
            extra.append(("action_taken", "error", "invalid_action",
                          f"NOT coalesce({clean['action_taken']} IN (1, 2, 3, 4, 5, 6, 7, 8), FALSE)",
                          "HMDA: {n} invalid action_taken codes"))
    aggs = ["count(*) AS rows_processed",
            (f"count(*) FILTER (WHERE NOT ({keep}))" if removes else "0") + " AS rows_removed",
            "(" + " + ".join(f"count(*) FILTER (WHERE {x})" for x in san) + ") AS values_sanitized" if san
            else "0 AS values_sanitized"]
    aggs += [f"count(*) FILTER (WHERE {ch[3]}) AS c{i}" for i, ch in enumerate(checks)]
    aggs += [f"count(*) FILTER (WHERE ({keep}) AND ({x[3]})) AS x{i}" for i, x in enumerate(extra)]
    parts = []
    for i, ch in enumerate(checks):
        parts.append(f"SELECT {_lit(ch[0])} AS \"column\", {_lit(ch[1])} AS severity, {_lit(ch[2])} AS \"check\", "
                     f"CAST(c{i} AS BIGINT) AS count, {_lit(ch[4])} AS template FROM agg")
    for i, x in enumerate(extra):
        parts.append(f"SELECT {_lit(x[0])}, {_lit(x[1])}, {_lit(x[2])}, CAST(x{i} AS BIGINT), {_lit(x[4])} FROM agg")
    for c, sev, kind, text in static:
        parts.append(f"SELECT {_lit(c)}, {_lit(sev)}, {_lit(kind)}, CAST(-1 AS BIGINT), {_lit(text)} FROM agg")
    return f"""
WITH agg AS (SELECT {', '.join(aggs)} FROM {source}),
items AS ({' UNION ALL '.join(parts)}),
issues AS (
SELECT {_lit(data_type)} AS data_type, "column", severity, "check",
       CASE WHEN count < 0 THEN NULL ELSE count END AS count,
       replace(template, '{{n}}', CAST(count AS VARCHAR)) AS message
FROM items WHERE count > 0 OR count = -1)
SELECT * FROM issues
UNION ALL
SELECT {_lit(data_type)}, NULL, 'info', 'summary', CAST(rows_processed AS BIGINT),
       printf('status=%s rows_processed=%d rows_removed=%d values_sanitized=%d',
              CASE WHEN (SELECT count(*) FROM issues WHERE severity = 'error') > 0 THEN 'errors'
                   WHEN (SELECT count(*) FROM issues WHERE severity = 'warning') > 0 THEN 'warnings'
                   ELSE 'success' END,
              rows_processed, rows_removed, values_sanitized)
FROM agg"""
