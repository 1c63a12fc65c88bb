"""Registry of named queries: a Spark callable plus, when SQL can express it,
the DuckDB oracle text.  Names are the SURVEY §2 ids in lower case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def round_half_up(c, digits: int = 6):
    """floor(x * 10^d + 0.5) / 10^d - the same IEEE operations in Spark and in
    the SQL oracle, so equal inputs round equally even on exact decimal ties
    (``round`` differs between the engines there).  NaN, inf and magnitudes
    beyond 1e12 pass through unchanged."""
    scale = float(10 ** digits)
    x = c.cast("double")
    return (F.when(F.isnan(x) | (F.abs(x) >= 1e12), x)
             .otherwise(F.floor(x * scale + 0.5) / scale))


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column so the Spark and DuckDB results hash alike."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    # Importing the plan modules fills the registry.
    from tractlens.plans import (  # noqa: F401
        dashboard, denial, features, forecasts, models, opportunity, preprocess, segment, sources, temporal, validation, yoy,
    )
