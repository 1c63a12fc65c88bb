"""Dashboard and report aggregates (SURVEY F9, F14, F15, F21-F25, F29, G6, H7,
H11, J4, 2.Q market-structure measures).

All are aggregates or windows on tract-level tables, or single-pass
aggregates over applications with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractlens.functions import parse
from tractlens.functions.stats import quantile_row

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
CURVE_BINS = {"debt_to_income_ratio": 5.0, "loan_to_value_ratio": 5.0, "credit_score": 25.0}
HISTOGRAM_BINS = 20
PURCHASE_CODES = [1]
REFINANCE_CODES = [31, 32]
# ---------------------------------------------------------------------------


def outcome_summary(apps: DataFrame) -> DataFrame:
    """valid (1..8), approved {1,2,6,8}, denied {3,7}, other, and rates of valid."""
    a = F.col("action_taken")
    valid = parse.valid_action(a)
    g = apps.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(valid).alias("valid_records"),
                 F.count_if(a.isin(parse.APPROVED_CODES)).alias("approved"),
                 F.count_if(a.isin(parse.DENIED_CODES)).alias("denied"))
    return g.withColumns({
        "other": F.col("valid_records") - F.col("approved") - F.col("denied"),
        "approval_rate": F.col("approved") / F.col("valid_records") * 100,
        "denial_rate": F.col("denied") / F.col("valid_records") * 100,
    })


def action_counts(apps: DataFrame) -> DataFrame:
    """F9 per-code counts with a grand-total row (``rollup``)."""
    return apps.rollup("action_taken").agg(F.count(F.lit(1)).alias("count"),
                                           (F.grouping("action_taken") == 1).alias("is_total"))


def yoy_export(metrics: DataFrame) -> DataFrame:
    """per (year, segment) total applications, mean approval and mean loan, 2 dp."""
    return metrics.groupBy("year", "market_segment").agg(
        F.sum("total_applications").cast("bigint").alias("total_applications"),
        F.round(F.avg("approval_rate"), 2).alias("avg_approval_rate"),
        F.round(F.avg("avg_loan_amount"), 2).alias("avg_loan_amount"))


def timeline_stats(timeline: DataFrame) -> DataFrame:
    """mean, sample std and count by (year, data_type)."""
    return timeline.groupBy("year", "data_type").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
                                                     F.count(F.lit(1)).alias("count"))


def approval_curves(df: DataFrame, widths: dict[str, float], approved_code: int = 1) -> DataFrame:
    """per feature, left-closed bins of its width; approval rate (action 1) and bin
    centre.  All features come from one scan: rows are unpivoted to (feature, bin)."""
    bins = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("width"),
                              F.floor(F.col(c) / w).alias("bin")) for c, w in widths.items()])
    approved = (F.col("action_taken") == approved_code).cast("double").alias("_approved")
    return (df.select(approved, F.explode(bins).alias("b")).select("_approved", "b.*")
              .filter(F.col("bin").isNotNull()).groupBy("feature", "width", "bin")
              .agg(F.count(F.lit(1)).alias("count"), (F.avg("_approved") * 100).alias("approval_rate"))
              .select("bin", "count", "approval_rate",
                      (F.col("bin") * F.col("width") + F.col("width") / 2).alias("bin_center"), "feature"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete rows), one aggregate, long form."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr"))
                      for a, b in pairs])
    return row.select(F.explode(items).alias("p")).select("p.*")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, 25/50/75 % (exact, linear) and max per column."""
    row = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
        F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    row = row.crossJoin(F.broadcast(quantile_row(df, {c: F.col(c) for c in cols}, [0.25, 0.5, 0.75])))
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                               F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                               F.col(f"{c}__min").alias("min"), F.col(f"{c}__q0").alias("p25"),
                               F.col(f"{c}__q1").alias("p50"), F.col(f"{c}__q2").alias("p75"),
                               F.col(f"{c}__max").alias("max")) for c in cols])
    return row.select(F.explode(items).alias("d")).select("d.*")


def histogram(df: DataFrame, col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """equal-width bins between min and max (max falls in the last bin); empty bins count 0."""
    st = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = F.col(col).cast("double")
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    counted = (df.filter(x.isNotNull()).crossJoin(F.broadcast(st)).groupBy(b.alias("bin"))
                 .agg(F.count(F.lit(1)).alias("count")))
    every = st.filter(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin", F.coalesce("count", F.lit(0)).alias("count"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) / bins * F.col("bin")).alias("bin_start"))


def tract_history(metrics: DataFrame, cols: Sequence[str] = ("total_applications", "approval_rate", "avg_loan_amount")) -> DataFrame:
    """every tract's yearly values with the change from its previous year
    (a single tract's view is a filter on this)."""
    w = Window.partitionBy("census_tract").orderBy("year")
    return metrics.select("census_tract", "year", *cols,
                          *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in cols])


def last_non_null(df: DataFrame, cols: Sequence[str], order: str = "year") -> DataFrame:
    """H7: per tract, the last non-null value of each column (pandas ``last``)."""
    return df.groupBy("census_tract").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def semi_filter(df: DataFrame, keys: DataFrame, key: str = "census_tract") -> DataFrame:
    """Keep rows whose key is in ``keys`` (left semi join, no duplicates)."""
    return df.join(keys.select(key), key, "left_semi")


def key_difference(a: DataFrame, b: DataFrame, key: str = "census_tract") -> DataFrame:
    """Keys of ``a`` missing from ``b`` and keys of ``b`` missing from ``a``."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return (ka.exceptAll(kb).withColumn("side", F.lit("left_only"))
              .unionByName(kb.exceptAll(ka).withColumn("side", F.lit("right_only"))))


def column_set_diff(columns_a: Sequence[str], columns_b: Sequence[str]) -> dict:
    """J4 (schema helper): common, missing and extra column names."""
    sa, sb = list(columns_a), set(columns_b)
    return {"common": [c for c in sa if c in sb], "missing": [c for c in columns_b if c not in set(sa)],
            "extra": [c for c in sa if c not in sb]}


def lender_concentration(apps: DataFrame, lenders: DataFrame) -> DataFrame:
    """2.Q: per tract lender count, Herfindahl index (sum of squared % shares)
    and the top lender's share - two aggregates, no per-tract loop."""
    j = apps.select("application_id", "census_tract").join(lenders, "application_id")
    per = j.groupBy("census_tract", "lender_key").agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy("census_tract").agg(F.sum("n").alias("_t"))
    s = per.join(tot, "census_tract").withColumn("share", F.col("n") / F.col("_t") * 100)
    return s.groupBy("census_tract").agg(
        F.count(F.lit(1)).alias("lender_count"), F.sum(F.col("share") * F.col("share")).alias("hhi"),
        F.max("share").alias("top_lender_share"), F.first("_t").alias("applications"))


def purpose_shares(apps: DataFrame) -> DataFrame:
    """2.Q: purchase and refinance share of applications per tract."""
    p = F.col("loan_purpose")
    return apps.groupBy("census_tract").agg(
        (F.count_if(p.isin(PURCHASE_CODES)) / F.count(F.lit(1)) * 100).alias("purchase_share"),
        (F.count_if(p.isin(REFINANCE_CODES)) / F.count(F.lit(1)) * 100).alias("refinance_share"))


def hpi_growth(hpi: DataFrame) -> DataFrame:
    """2.Q: 1-year and 3-year HPI growth (% over the tract's row 1 / 3 years
    back in its own series) and volatility (population std of yearly growth)."""
    w = Window.partitionBy("census_tract").orderBy("year")
    g = hpi.select("census_tract", "year", "hpi",
                   ((F.col("hpi") / F.lag("hpi", 1).over(w) - 1) * 100).alias("growth_1y"),
                   ((F.col("hpi") / F.lag("hpi", 3).over(w) - 1) * 100).alias("growth_3y"))
    vol = g.groupBy("census_tract").agg(F.stddev_pop("growth_1y").alias("hpi_volatility"))
    return g.join(vol, "census_tract", "left")


def pipeline_summary(scored: DataFrame, profiles: DataFrame, apps: DataFrame) -> DataFrame:
    """one-row run summary: tracts, average score, population, level mix,
    segments, records and approval rate."""
    s = scored.agg(F.count(F.lit(1)).alias("total_census_tracts"), F.avg("opportunity_score").alias("average_opportunity_score"),
                   F.sum("total_population").cast("bigint").alias("total_population"),
                   F.count_if(F.col("opportunity_level") == "High").alias("high_tracts"))
    p = profiles.agg(F.count(F.lit(1)).alias("segments"))
    a = apps.agg(F.count(F.lit(1)).alias("records"),
                 (F.avg(parse.approved_broad(F.col("action_taken"))) * 100).alias("approval_rate"))
    return s.crossJoin(p).crossJoin(a)
