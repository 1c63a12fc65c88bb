"""Forecast panel, model inputs, future rows and insight tables.

The panel has one row per tract and year; windows run within a tract.  Global medians
come from value counts (``functions.stats``) as one broadcast row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlens.functions.columns import clip, half_up
from tractlens.functions.stats import quantile_row
from tractlens.operators.temporal import confidence_band

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
PANEL_FEATURES = ["opportunity_score", "market_accessibility", "risk_factors", "economic_indicators", "lending_activity"]
LAGS, AVERAGES = (1, 2, 3), (2, 3)
CYCLE_YEARS = 10
KEEP_SHARE = 0.7
DEFAULT_INPUT = 50.0
CONFIDENCE_LOW, CONFIDENCE_HIGH, CONFIDENCE_MIDDLE = (20, 0.7), (80, 0.8), (40, 70, 1.1)
TOP_CHANGES = 5
# ---------------------------------------------------------------------------


def forecast_panel(scores: DataFrame, features: Sequence[str] = PANEL_FEATURES, lags: Sequence[int] = LAGS,
                   averages: Sequence[int] = AVERAGES) -> DataFrame:
    """H2 / H4 / H5: lags, changes, trailing means (as many years as there are), the year's
    place between the tract's first and last (null for equal ones) and a 10-year cycle;
    tracts with one year are dropped."""
    w = Window.partitionBy("census_tract").orderBy("year")
    tract = Window.partitionBy("census_tract")
    s = scores.withColumn("_years", F.count(F.lit(1)).over(tract)).filter(F.col("_years") >= 2).drop("_years")
    cols = {}
    for c in features:
        for k in lags:
            cols[f"{c}_lag_{k}"] = F.lag(c, k).over(w)
        for k in averages:
            cols[f"{c}_ma_{k}"] = F.avg(c).over(w.rowsBetween(-(k - 1), 0))
        cols[f"{c}_trend"] = F.col(c) - F.lag(c, 1).over(w)
    first, last = F.min("year").over(tract), F.max("year").over(tract)
    turn = F.col("year") * (2 * math.pi / CYCLE_YEARS)
    cols |= {"year_position": F.try_divide((F.col("year") - first).cast("double"), last - first),
             "year_sin": F.sin(turn), "year_cos": F.cos(turn)}
    return s.withColumns(cols)


def input_names(panel: DataFrame, features: Sequence[str] = PANEL_FEATURES) -> list[str]:
    """Lags, trailing means and the cycle, as far as the panel has them."""
    names = [f"{c}_lag_{k}" for c in features for k in LAGS] + [f"{c}_ma_{k}" for c in features for k in AVERAGES]
    return [c for c in [*names, "year_sin", "year_cos"] if c in panel.columns]


def forecast_inputs(panel: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least 70 % of the inputs; the gaps left get the input's median over these rows."""
    names = list(names or input_names(panel))
    known = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    kept = panel.filter(known >= KEEP_SHARE * len(names))
    medians = quantile_row(kept, {c: F.col(c) for c in names}, [0.5])
    return kept.crossJoin(F.broadcast(medians)).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"{c}__q0")) for c in names}).drop(*medians.columns)


def future_rows(current: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inputs of a year to come: a lag or mean is the current value, a trend is 0, an input
    that the rows lack is 50; gaps get the input's median, else 50."""
    def value(c: str) -> Column:
        base = c.split("_lag_")[0].split("_ma_")[0]
        if c in current.columns:
            return F.col(c).cast("double")
        if base != c:
            return F.col(base).cast("double") if base in current.columns else F.lit(DEFAULT_INPUT)
        return F.lit(0.0) if "_trend" in c else F.lit(DEFAULT_INPUT)

    rows = current.withColumns({c: value(c) for c in names})
    medians = quantile_row(rows, {c: F.col(c) for c in names}, [0.5])
    return rows.crossJoin(F.broadcast(medians)).withColumns(
        {c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.col(f"{c}__q0"), F.lit(DEFAULT_INPUT))
         for c in names}).drop(*medians.columns)


def score_confidence(score: Column) -> Column:
    """L10, second rule: 100, times 0.7 below 20, 0.8 above 80, 1.1 within 40..70, at most 100."""
    low, high, middle = CONFIDENCE_LOW, CONFIDENCE_HIGH, CONFIDENCE_MIDDLE
    share = (F.when(score < low[0], low[1]).when(score > high[0], high[1])
             .when(score.between(middle[0], middle[1]), middle[2]).otherwise(1.0))
    return clip(share * 100, 0, 100)


def with_confidence(predictions: DataFrame, score: str = "predicted_opportunity_score") -> DataFrame:
    """L10 + H13: confidence by score and its band."""
    low, high = confidence_band(F.col(score), score_confidence(F.col(score)))
    return predictions.withColumns({"prediction_confidence": score_confidence(F.col(score)),
                                    "confidence_low": low, "confidence_high": high})


def forecast_insights(forecasts: DataFrame, score: str = "predicted_opportunity_score",
                      level: str = "predicted_opportunity_level") -> DataFrame:
    """L11 (F17 + I8): one long table ``(insight, years_ahead, key, value)`` of level counts,
    score means and deviations (2 dp), the number of tracts, and the five largest rises and
    falls of a tract's score from the first to the last horizon."""
    row = lambda name, h, key, value: [F.lit(name).alias("insight"), h.cast("int").alias("years_ahead"),
                                       key.cast("string").alias("key"), value.cast("double").alias("value")]
    none, h = F.lit(None), F.col("years_ahead")
    levels = forecasts.groupBy("years_ahead", level).agg(F.count(F.lit(1)).alias("n")).select(
        *row("level_count", h, F.col(level), F.col("n")))
    stats = forecasts.groupBy("years_ahead").agg(F.avg(score).alias("m"), F.stddev_samp(score).alias("s"))
    means = stats.select(*row("score_mean", h, none, half_up(F.col("m"), 2)))
    spreads = stats.select(*row("score_std", h, none, half_up(F.col("s"), 2)))
    total = forecasts.agg(F.count_distinct("census_tract").alias("n")).select(*row("total_tracts", none, none, F.col("n")))
    ends = forecasts.crossJoin(F.broadcast(forecasts.agg(F.min("years_ahead").alias("_a"), F.max("years_ahead").alias("_z"))))
    change = (ends.filter("_a < _z").groupBy("census_tract").agg(
        (F.max(F.when(h == F.col("_z"), F.col(score))) - F.max(F.when(h == F.col("_a"), F.col(score)))).alias("d"))
        .filter("d IS NOT NULL"))
    up = change.orderBy(F.desc("d"), "census_tract").limit(TOP_CHANGES)
    down = change.orderBy("d", "census_tract").limit(TOP_CHANGES)
    return (levels.unionByName(means).unionByName(spreads).unionByName(total)
            .unionByName(up.select(*row("top_improving", none, F.col("census_tract"), F.col("d"))))
            .unionByName(down.select(*row("top_declining", none, F.col("census_tract"), F.col("d")))))
