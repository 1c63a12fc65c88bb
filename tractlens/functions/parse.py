"""Parsers for the text-coded HMDA columns.

The reference has several incompatible parsers for the same column.  Each is
kept as its own named function (never merged), all built from JVM-side
expressions: ``when`` chains, ``regexp_*`` and ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractlens.functions.columns import null_d, div, round2

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (HMDA code semantics).
# Outcome sets by action_taken code, one per job that defines them.
APPROVED_CODES = [1, 2, 6, 8]          # pipeline / feature engineer
DENIED_CODES = [3, 7]                  # pipeline / feature engineer
ORIGINATED_CODE = 1                    # YoY analyzer and temporal scorer
DENIED_CODE = 3                        # YoY analyzer and platform rollup
WITHDRAWN_CODE = 4                     # YoY analyzer
# DTI labels and their stand-in values (parser v1 and v3).
DTI_LABELS_V1 = {"<20%": 15.0, "20%-<30%": 25.0, "30%-<36%": 33.0, "50%-60%": 55.0, ">60%": 70.0}
# Text that means "no value".
NA_TEXTS = ["nan", "NA", "", "Exempt"]
# ---------------------------------------------------------------------------


def _dbl(c: Column) -> Column:
    return F.nanvl(c.try_cast("double"), null_d())


def tract_key(c: Column) -> Column:
    """Normalise a tract id.  '20091050100.0' -> '20091050100'; null, 'NA',
    'Unknown' and unparsable text -> null (callers drop those rows)."""
    s = F.trim(c.cast("string"))
    as_int = s.try_cast("double").try_cast("bigint")
    return F.when(s.isNull() | s.isin("NA", "Unknown", "nan", ""), F.lit(None).cast("string")) \
            .otherwise(as_int.cast("string"))


def valid_action(c: Column) -> Column:
    """Action code in 1..8."""
    return c.isNotNull() & c.between(1, 8)


# C4: the four outcome definitions -----------------------------------------
def approved_broad(action: Column) -> Column:
    """(a) approved = {1,2,6,8}."""
    return action.isin(APPROVED_CODES).cast("int")


def denied_broad(action: Column) -> Column:
    """(a) denied = {3,7}."""
    return action.isin(DENIED_CODES).cast("int")


def denied_strict(action: Column) -> Column:
    """(b)/(c) denied = {3}."""
    return (action == DENIED_CODE).cast("int")


def originated(action: Column) -> Column:
    """(c)/(d) originated / approved = {1}."""
    return (action == ORIGINATED_CODE).cast("int")


def withdrawn(action: Column) -> Column:
    return (action == WITHDRAWN_CODE).cast("int")


def model_target(action: Column) -> Column:
    """1 approved, 0 denied, -1 excluded."""
    return (F.when(action.isin(APPROVED_CODES), 1).when(action.isin(DENIED_CODES), 0)
             .otherwise(-1).cast("int"))


# DTI parsers ---------------------------------------------------------------
def dti_v1(c: Column) -> Column:
    """C6 (tract pipeline): exact labels, else the number, else null."""
    s = c.cast("string")
    out = F.when(s.isNull() | (s == "Exempt"), null_d())
    for label, value in DTI_LABELS_V1.items():
        out = out.when(s == label, F.lit(value))
    return out.otherwise(_dbl(s))


def dti_v2(c: Column) -> Column:
    """C7 (feature engineer): strip '%'; '>X' -> X+5; '<X' -> max(0, X-5);
    'a-<b' and 'a-b' -> midpoint; else the number."""
    t = F.trim(c.cast("string"))
    s = F.regexp_replace(t, "%", "")
    rest = F.substring(s, 2, 1 << 20)
    lt_val = _dbl(rest)
    p_lt = F.split(s, "-<")
    p_dash = F.split(s, "-")
    mid_lt = (_dbl(p_lt.getItem(0)) + _dbl(p_lt.getItem(1))) / 2
    mid_dash = (_dbl(p_dash.getItem(0)) + _dbl(p_dash.getItem(1))) / 2
    return (F.when(c.isNull() | t.isin("nan", "NA", "", "Exempt") | (F.lower(t) == "exempt"), null_d())
             .when(s.startswith(">"), lt_val + 5)
             .when(s.startswith("<"), F.when(lt_val.isNotNull(), F.greatest(F.lit(0.0), lt_val - 5)))
             .when(s.contains("-<") & (F.size(p_lt) == 2), mid_lt)
             .when(s.contains("-<"), null_d())
             .when(s.contains("-") & ~s.startswith("-") & (F.size(p_dash) == 2)
                   & mid_dash.isNotNull(), mid_dash)
             .otherwise(_dbl(s)))


def dti_v3(c: Column) -> Column:
    """C8 (temporal scorer): labels matched by substring; numeric *text* is
    ignored (null), as in the reference."""
    s = c.cast("string")
    out = F.when(s.isNull() | (s == "Exempt"), null_d())
    for label, value in DTI_LABELS_V1.items():
        out = out.when(s.contains(label), F.lit(value))
    return out.otherwise(null_d())


def dti_v4(c: Column) -> Column:
    """C9 (YoY): drop '%', '>' and '<' then parse; ranges become null."""
    return _dbl(F.regexp_replace(c.cast("string"), "[%<>]", ""))


# LTV parsers ---------------------------------------------------------------
def ltv_v1(c: Column) -> Column:
    """C10 v1: number or null (percent)."""
    s = c.cast("string")
    return F.when(s.isNull() | (s == "Exempt"), null_d()).otherwise(_dbl(s))


def ltv_v2(c: Column) -> Column:
    """C10 v2: strip '%'; values above 1 are percents and divided by 100 (fraction)."""
    s = c.cast("string")
    v = _dbl(F.regexp_replace(s, "%", ""))
    return (F.when(s.isNull() | s.isin(*NA_TEXTS), null_d())
             .when(v > 1, v / 100).otherwise(v))


def ltv_percent(c: Column) -> Column:
    """A text LTV as the percent it says, with or without '%'; else null."""
    return _dbl(F.regexp_replace(F.trim(c.cast("string")), "%", ""))


def to_number(c: Column) -> Column:
    """C11: ``pd.to_numeric(errors='coerce')``."""
    return _dbl(c)


# C12 census derived rates ---------------------------------------------------
def unemployment_rate(unemployed: Column, labor_force: Column) -> Column:
    return round2(div(unemployed, labor_force) * 100)


def ownership_rate(owner: Column, renter: Column) -> Column:
    return round2(div(owner, owner + renter) * 100)
