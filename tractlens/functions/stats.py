"""Exact medians and quantiles in one lazy plan for every size.

A built-in exact percentile keeps a group's distinct values in one buffer, which
is fatal for a group that holds a third of the table.  Here no task sees a whole
group, and rows are never ranked, only distinct values with their counts:

1. *Value counts*: ``groupBy(keys, metric, value).count()``, a partial aggregate, so
   tied values cost one row per task.
2. *Buckets*: values fall into ``SCALE`` buckets per power of two (a monotonic
   function of the value, the same for every group); a running count over a group's
   buckets gives the rank at which each begins.  A group has at most ``SCALE`` rows
   here per power of two that its values span.
3. *Selection*: only the buckets that hold a wanted rank keep their values, which are
   counted through in order, one bucket at a time.

All metrics and probabilities go through the same plan together.  Quantiles of whole columns
(``quantile_row``) first let a mergeable sketch bracket the ranks, so that only the values
around them are counted and shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlens.session import ensure_checkpoint_dir

INF = math.inf
#: Buckets per power of two: values of one bucket agree to about one part in 6,000.
SCALE = 4096
#: Above the exponent of the smallest double (-1074), so that bucket numbers are positive.
_SHIFT = 1100


def materialize_small(df: DataFrame) -> DataFrame:
    """Checkpoint a small intermediate (one row of bounds) to the shared
    checkpoint folder.  This cuts the lineage of multi-step plans, and the
    result survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bucket(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises (``log2`` is semi-monotonic)."""
    size = F.least(F.log2(F.abs(v)), F.lit(1024.0))
    steps = F.floor((size + _SHIFT) * SCALE) + 1
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, steps).otherwise(-steps)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the left side's keys stay."""
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_r_{i}") for i, k in enumerate(keys)],
                           *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def _at_ranks(counts: DataFrame, k: Sequence[str], places: Sequence[Column]) -> DataFrame:
    """Values at fractional ranks ``places`` (expressions of ``_n``) as ``q0, q1, ...``, from value
    counts ``(k, _v, _c, _n0)`` of at least the lowest values of each group, which has ``_n0`` in all
    (null: as many as are counted here)."""
    counts = counts.withColumn("_b", _bucket(F.col("_v")))
    group = Window.partitionBy(*k)
    buckets = (counts.groupBy(*k, "_b").agg(F.sum("_c").alias("_bc"), F.first("_n0").alias("_n0"))
               .withColumn("_begin", F.sum("_bc").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bc"))
               .withColumn("_n", F.coalesce("_n0", F.sum("_bc").over(group))))
    ranks = [r for at in places for r in (F.floor(at), F.ceil(at))]
    wanted = reduce(lambda a, b: a | b, [(F.col("_begin") <= r) & (r < F.col("_begin") + F.col("_bc")) for r in ranks])
    inside = _null_safe(counts.drop("_n0"), buckets.filter(wanted).drop("_bc", "_n0"), [*k, "_b"])
    through = Window.partitionBy(*k, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_begin") + F.sum("_c").over(through))
    at_rank = lambda r: F.max(F.when((F.col("_end") - F.col("_c") <= r) & (r < F.col("_end")), F.col("_v")))
    picked = inside.groupBy(*k).agg(
        F.first("_n").alias("_n"), *[at_rank(r).alias(f"_x{i}") for i, r in enumerate(ranks)])
    return picked.select(*[F.col(f"`{c}`") for c in k], *[
        (F.when(F.col(f"_x{2 * i}") == F.col(f"_x{2 * i + 1}"), F.col(f"_x{2 * i}")).otherwise(
            F.col(f"_x{2 * i}") * (1 - (at - F.floor(at))) + F.col(f"_x{2 * i + 1}") * (at - F.floor(at)))).alias(f"q{i}")
        for i, at in enumerate(places)])


def _real(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def quantiles(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column], probs: Sequence[float]) -> DataFrame:
    """``(keys, _metric, q0, q1, ...)``: exact linear-interpolated quantiles (as pandas) of
    every metric per group; nulls and NaN are ignored, and a metric without values has no row."""
    k = [*keys, "_metric"]
    vals = [F.struct(F.lit(n).alias("m"), _real(c).alias("v")) for n, c in metrics.items()]
    long = df.select(*[F.col(f"`{c}`") for c in keys], F.explode(F.array(*vals)).alias("_mv")) \
             .select(*[F.col(f"`{c}`") for c in keys], F.col("_mv.m").alias("_metric"), F.col("_mv.v").alias("_v")) \
             .filter(F.col("_v").isNotNull())
    counts = long.groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_n0", F.lit(None).cast("bigint"))
    return _at_ranks(counts, k, [(F.col("_n") - 1) * F.lit(float(p)) for p in probs])


#: The sketch of a whole column's quantiles is right to one part in this many rows.
SKETCH_ACCURACY = 5_000


def quantile_row(df: DataFrame, metrics: Mapping[str, Column], probs: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """One row with ``<metric>__q0, ...`` over the whole frame; null where a metric has no values.

    Exact, without moving the columns: a mergeable sketch (a few thousand numbers for each metric
    and task) brackets every wanted rank between two values, twice its error away; a second pass
    counts the values below each bracket (as one value) and hands on those inside, about
    ``4 / accuracy`` of them, on which the rank is found as in ``quantiles``.  A column of up to
    ``accuracy`` values is inside as a whole."""
    names = list(metrics)
    long = df.select(F.posexplode(F.array(*[_real(metrics[n]) for n in names])).alias("_metric", "_v")).filter(F.col("_v").isNotNull())
    ends = [min(1.0, max(0.0, p + side * 2 / accuracy)) for p in probs for side in (-1, 1)]
    sketch = long.groupBy("_metric").agg(F.count(F.lit(1)).alias("_n0"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    wide = F.col("_n0") <= accuracy
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p"), F.when(wide, -INF).otherwise(F.col("_e")[2 * i]).alias("_lo"),
                               F.when(wide, INF).otherwise(F.col("_e")[2 * i + 1]).alias("_hi")) for i, p in enumerate(probs)])
    # A row for each metric and probability.
    brackets = materialize_small(sketch.select("_metric", "_n0", F.explode(cells).alias("_c")).select("_metric", "_n0", "_c.*"))
    counts = (long.join(F.broadcast(brackets), "_metric").filter(F.col("_v") <= F.col("_hi"))
              .groupBy("_metric", "_i", "_p", F.when(F.col("_v") < F.col("_lo"), -INF).otherwise(F.col("_v")).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c"), F.first("_n0").alias("_n0")))
    found = _at_ranks(counts, ["_metric", "_i", "_p"], [(F.col("_n") - 1) * F.col("_p")])
    missing = F.raise_error(F.lit("a quantile's rank is outside its sketch's bracket")).cast("double")
    at = lambda j, i: (F.col("_metric") == j) & (F.col("_i") == i)
    return brackets.select("_metric", "_i").join(found, ["_metric", "_i"], "left").withColumn("q0", F.coalesce("q0", missing)).agg(
        *[F.max(F.when(at(j, i), F.col("q0"))).alias(f"{n}__q{i}") for j, n in enumerate(names) for i in range(len(probs))])


def grouped_agg_with_medians(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
                             medians: Mapping[str, Column]) -> DataFrame:
    """``df.groupBy(keys).agg(*aggs, median(m) for m in medians)`` that survives skew.

    ``medians`` maps an output name to a numeric column expression.  Null and
    NaN inputs are ignored, as in pandas.
    """
    keys = list(keys)
    main = df.groupBy(*keys).agg(*aggs)
    if not medians:
        return main
    wide = quantiles(df, keys, medians, [0.5]).groupBy(*[F.col(f"`{c}`") for c in keys]).agg(
        *[F.max(F.when(F.col("_metric") == n, F.col("q0"))).alias(n) for n in medians])
    return _null_safe(main, wide, keys, "left")


def exact_quantiles(df: DataFrame, value: Column | str, probs: Sequence[float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of one value, ``q0, q1, ...``: per group of ``keys``, or one row for the whole frame."""
    v = F.col(value) if isinstance(value, str) else value
    if keys:
        return quantiles(df, keys, {"v": v}, probs).drop("_metric")
    return quantile_row(df, {"v": v}, probs).select(*[F.col(f"v__q{i}").alias(f"q{i}") for i in range(len(probs))])
