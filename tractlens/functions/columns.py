"""Small Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def null_d() -> Column:
    return F.lit(None).cast("double")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    """Numeric coercion: text or number to double, unparsable to null, NaN to null."""
    x = F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.nanvl(x, null_d())


def div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (ANSI-safe)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column, zero_default: float | None = 0.0) -> Column:
    """a / b * 100; ``zero_default`` when b <= 0 (the reference's ``if b > 0 else 0``)."""
    v = div(a, b) * F.lit(100.0)
    if zero_default is None:
        return v
    return F.when(b > 0, v).otherwise(F.lit(zero_default))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """np.clip that keeps null (``least``/``greatest`` would skip it)."""
    out = c
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return F.when(c.isNull(), null_d()).otherwise(out.cast("double"))


def round_to(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits)


def round2(c: Column) -> Column:
    """2-dp rounding computed identically in Spark and in the SQL oracle:
    half up on the binary value, ``floor(x * 100 + 0.5) / 100`` (SURVEY T6)."""
    return F.floor(c * 100 + 0.5) / 100


def half_up(c: Column, digits: int) -> Column:
    """``floor(x * 10^digits + 0.5) / 10^digits``, the same operations as in the SQL oracle."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def one_decimal(c: Column) -> Column:
    """Text of a number with one decimal, rounded half up without printf."""
    tenths = F.floor(c * 10 + 0.5).cast("bigint")
    size = F.abs(tenths)
    return F.concat(F.when(tenths < 0, F.lit("-")).otherwise(F.lit("")), (size.cast("decimal(20,0)") / 10).cast("decimal(21,1)").cast("string"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_mean(cols: Sequence[Column]) -> Column:
    """Row mean that skips nulls (pandas ``mean(axis=1)``); null when all are null."""
    s = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.when(n > 0, s / n)


def bands(c: Column, edges: Sequence[float], labels: Sequence[str],
          include_lowest: bool = False) -> Column:
    """``pd.cut(c, edges, labels)``: right-closed bins ``(a, b]``; outside -> null."""
    assert len(labels) == len(edges) - 1
    out = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower_ok = (c >= F.lit(lo)) if (include_lowest and i == 0) else (c > F.lit(lo))
        cond = lower_ok & (c <= F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def code_map(c: Column, mapping: dict, default=None) -> Column:
    """Literal lookup (dict) as a chain of ``when``; unknown -> default."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    if default is not None:
        out = out.otherwise(F.lit(default))
    return out


def non_null_array(items: Iterable[Column]) -> Column:
    """array(...) without nulls - the 'list.append under a condition' idiom."""
    return F.array_compact(F.array(*items))
