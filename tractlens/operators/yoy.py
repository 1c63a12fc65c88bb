"""Year-over-year tract performance.

Shape of the work at scale
--------------------------
* ``tract_year_metrics`` is one hash aggregate on (year, tract) with partial
  (map-side) aggregation; medians go through the skew-safe helper.
* Everything after it runs on the tract x year table, which is orders of
  magnitude smaller than the application table.  Windows partition by tract
  (never an unpartitioned window); global scalars (latest year) are one-row
  aggregates joined back by broadcast.
* Top-k uses ``orderBy().limit(k)``, which Spark plans as a per-partition
  top-k followed by a single small merge (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlens.functions import parse
from tractlens.functions.columns import half_up, one_decimal, pct
from tractlens.functions.stats import grouped_agg_with_medians

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
# Market segment by average loan amount (K1), highest first.
SEGMENT_LIMITS = [(400000, "Luxury"), (250000, "Premium"), (150000, "Mainstream"),
                  (100000, "Value")]
SEGMENT_DEFAULT = "Affordable"
# Performance tier (K2): (minimum approval rate %, minimum applications, label).
TIER_RULES = [(70, 50, "High Performer"), (60, 30, "Strong Performer"),
              (50, 15, "Moderate Performer"), (40, 0, "Challenging Market")]
TIER_DEFAULT = "Difficult Market"
# Improvement score weights.
VOLUME_WEIGHT, APPROVAL_WEIGHT = 0.4, 0.6
# ---------------------------------------------------------------------------


def market_segment(avg_loan):
    """K1."""
    out = None
    for limit, label in SEGMENT_LIMITS:
        cond = avg_loan >= limit
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(SEGMENT_DEFAULT)


def performance_tier(approval_rate, volume):
    """K2."""
    out = None
    for rate, vol, label in TIER_RULES:
        cond = (approval_rate >= rate) & (volume >= vol)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(TIER_DEFAULT)


def tract_year_metrics(apps: DataFrame, year_col: str = "activity_year") -> DataFrame:
    """one row per (census_tract, year) with volume, rates, amounts and mix."""
    a = (apps.filter(F.col("census_tract").isNotNull())
             .select(F.col("census_tract"), F.col(year_col).cast("int").alias("year"),
                     "action_taken", F.col("loan_amount").cast("double").alias("loan_amount"),
                     parse.to_number(F.col("income")).alias("income"),
                     parse.dti_v4(F.col("debt_to_income_ratio")).alias("dti"),
                     parse.to_number(F.col("interest_rate")).alias("rate"),
                     "loan_type",
                     parse.to_number(F.col("property_value")).alias("pv")))
    act = F.col("action_taken")
    n = F.count(F.lit(1))
    g = grouped_agg_with_medians(
        a, ["census_tract", "year"],
        [n.alias("total_applications"),
         F.count_if(act == 1).alias("total_originations"),
         F.count_if(act == 3).alias("total_denials"),
         F.count_if(act == 4).alias("total_withdrawals"),
         F.avg("loan_amount").alias("avg_loan_amount"),
         F.coalesce(F.sum(F.when(act == 1, F.col("loan_amount"))), F.lit(0.0)).alias("total_loan_volume"),
         F.avg("income").alias("avg_income"),
         F.avg("dti").alias("avg_dti"),
         F.avg("rate").alias("avg_interest_rate"),
         F.avg("pv").alias("avg_property_value"),
         F.count_if(F.col("loan_type") == 1).alias("_lt1"),
         F.count_if(F.col("loan_type") == 2).alias("_lt2"),
         F.count_if(F.col("loan_type") == 3).alias("_lt3")],
        {"median_loan_amount": F.col("loan_amount"), "median_income": F.col("income"),
         "median_dti": F.col("dti"), "median_interest_rate": F.col("rate"),
         "median_property_value": F.col("pv")})
    apps_n = F.col("total_applications")
    out = (g.withColumn("approval_rate", pct(F.col("total_originations"), apps_n))
            .withColumn("denial_rate", pct(F.col("total_denials"), apps_n))
            .withColumn("withdrawal_rate", pct(F.col("total_withdrawals"), apps_n))
            .withColumn("conventional_pct", pct(F.col("_lt1"), apps_n))
            .withColumn("fha_pct", pct(F.col("_lt2"), apps_n))
            .withColumn("va_pct", pct(F.col("_lt3"), apps_n)))
    out = (out.withColumn("market_segment", market_segment(F.col("avg_loan_amount")))
              .withColumn("performance_tier", performance_tier(F.col("approval_rate"), apps_n)))
    return out.select(
        "census_tract", "year", "total_applications", "total_originations", "total_denials",
        "total_withdrawals", "approval_rate", "denial_rate", "withdrawal_rate",
        "avg_loan_amount", "median_loan_amount", "total_loan_volume", "avg_income",
        "median_income", "avg_dti", "median_dti", "avg_interest_rate", "median_interest_rate",
        "avg_property_value", "median_property_value", "conventional_pct", "fha_pct", "va_pct",
        "market_segment", "performance_tier")


def _change_pct(cur, prev):
    return F.when(prev > 0, (cur - prev) / prev * 100).otherwise(F.lit(0.0))


def yoy_changes(metrics: DataFrame) -> DataFrame:
    """H1: change between consecutive *present* years of each tract (a gap year
    is bridged, as in the reference; from_year/to_year show it)."""
    w = Window.partitionBy("census_tract").orderBy("year")
    m = metrics.select(
        "census_tract", "year", "total_applications", "approval_rate", "avg_loan_amount",
        "avg_income", "market_segment", "performance_tier",
        F.lag("year").over(w).alias("from_year"),
        F.lag("total_applications").over(w).alias("p_apps"),
        F.lag("approval_rate").over(w).alias("p_rate"),
        F.lag("avg_loan_amount").over(w).alias("p_loan"),
        F.lag("avg_income").over(w).alias("p_income"))
    return (m.filter(F.col("from_year").isNotNull())
             .select("census_tract", F.col("from_year").cast("int").alias("from_year"),
                     F.col("year").alias("to_year"),
                     _change_pct(F.col("total_applications"), F.col("p_apps")).alias("volume_change_pct"),
                     (F.col("approval_rate") - F.col("p_rate")).alias("approval_rate_change"),
                     _change_pct(F.col("avg_loan_amount"), F.col("p_loan")).alias("loan_amount_change_pct"),
                     _change_pct(F.col("avg_income"), F.col("p_income")).alias("income_change_pct"),
                     F.col("total_applications").alias("current_volume"),
                     F.col("approval_rate").alias("current_approval_rate"),
                     F.col("avg_loan_amount").alias("current_avg_loan"),
                     "market_segment", "performance_tier"))


def _latest(df: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` equals its global maximum (one-row broadcast)."""
    mx = df.agg(F.max(col).alias("_max"))
    return df.join(F.broadcast(mx), F.col(col) == F.col("_max"), "inner").drop("_max")


def top_movers(changes: DataFrame, k: int = 10) -> DataFrame:
    """Top improvers and decliners of the latest to_year by
    0.4 * volume change + 0.6 * approval change; ties by tract id."""
    latest = (_latest(changes, "to_year")
              .withColumn("improvement_score",
                          F.col("volume_change_pct") * VOLUME_WEIGHT
                          + F.col("approval_rate_change") * APPROVAL_WEIGHT)
              .filter(F.col("improvement_score").isNotNull()))
    cols = ["census_tract", "to_year", "volume_change_pct", "approval_rate_change",
            "improvement_score", "current_volume", "current_approval_rate", "market_segment"]
    up = (latest.orderBy(F.desc("improvement_score"), F.asc("census_tract")).limit(k)
                .select(*cols, F.lit("improver").alias("direction")))
    down = (latest.orderBy(F.asc("improvement_score"), F.asc("census_tract")).limit(k)
                  .select(*cols, F.lit("decliner").alias("direction")))
    both = up.unionByName(down)
    w = Window.partitionBy("direction").orderBy(
        F.when(F.col("direction") == "improver", -F.col("improvement_score"))
         .otherwise(F.col("improvement_score")), "census_tract")
    return both.withColumn("rank", F.row_number().over(w).cast("int"))


def first_last(metrics: DataFrame) -> DataFrame:
    """First and last year per tract (tracts with >= 2 years), growth and gain."""
    s = F.struct("year", "total_applications", "approval_rate", "market_segment", "avg_loan_amount")
    g = metrics.groupBy("census_tract").agg(
        F.count(F.lit(1)).alias("n_years"), F.min_by(s, F.col("year")).alias("f"),
        F.max_by(s, F.col("year")).alias("l"))
    return (g.filter(F.col("n_years") >= 2)
             .select("census_tract", "n_years",
                     F.col("f.year").alias("first_year"), F.col("l.year").alias("last_year"),
                     _change_pct(F.col("l.total_applications"), F.col("f.total_applications"))
                      .alias("volume_growth_pct"),
                     (F.col("l.approval_rate") - F.col("f.approval_rate")).alias("approval_improvement"),
                     F.col("l.total_applications").alias("current_volume"),
                     F.col("l.approval_rate").alias("current_approval_rate"),
                     F.col("l.market_segment").alias("market_segment"),
                     F.col("l.avg_loan_amount").alias("avg_loan_amount")))


def growth_leaders(metrics: DataFrame, k: int = 10, min_growth: float = 20.0,
                   min_gain: float = 5.0) -> DataFrame:
    """Growth > 20 % and approval gain > 5 points, top k by growth."""
    fl = first_last(metrics)
    return (fl.filter((F.col("volume_growth_pct") > min_growth)
                      & (F.col("approval_improvement") > min_gain))
              .orderBy(F.desc("volume_growth_pct"), "census_tract").limit(k)
              .select("census_tract", "volume_growth_pct", "approval_improvement",
                      "current_volume", "current_approval_rate", "market_segment"))


def emerging_markets(metrics: DataFrame, k: int = 15, lo: int = 20, hi: int = 100,
                     min_rate: float = 50.0) -> DataFrame:
    """Latest volume in [20, 100], approval >= 50 and any growth; top k by growth."""
    fl = first_last(metrics)
    return (fl.filter(F.col("current_volume").between(lo, hi)
                      & (F.col("current_approval_rate") >= min_rate)
                      & (F.col("volume_growth_pct") > 0))
              .orderBy(F.desc("volume_growth_pct"), "census_tract").limit(k)
              .select("census_tract", "current_volume", "current_approval_rate",
                      "volume_growth_pct", "market_segment", "avg_loan_amount"))


def segment_year(metrics: DataFrame) -> DataFrame:
    """F4 (first level) / F26: per (segment, year) sums and means, 2 dp."""
    return (metrics.groupBy("market_segment", "year")
                   .agg(F.sum("total_applications").cast("bigint").alias("total_applications"),
                        F.round(F.avg("approval_rate"), 2).alias("approval_rate"),
                        F.round(F.avg("avg_loan_amount"), 2).alias("avg_loan_amount"),
                        F.round(F.sum("total_loan_volume"), 2).alias("total_loan_volume")))


def segment_trends(metrics: DataFrame) -> DataFrame:
    """per segment volume trend (mean pct change x 100), approval trend (mean
    diff), distinct tracts and modal tier (smallest label on ties)."""
    sy = segment_year(metrics)
    w = Window.partitionBy("market_segment").orderBy("year")
    p_apps = F.lag("total_applications").over(w)
    p_rate = F.lag("approval_rate").over(w)
    steps = sy.select("market_segment",
                      F.try_divide(F.col("total_applications") - p_apps, p_apps.cast("double")).alias("pc"),
                      (F.col("approval_rate") - p_rate).alias("d"))
    trend = steps.groupBy("market_segment").agg(
        F.count(F.lit(1)).alias("n_years"),
        (F.avg("pc") * 100).alias("volume_trend_pct"), F.avg("d").alias("approval_rate_trend"))
    info = metrics.groupBy("market_segment").agg(
        F.count_distinct("census_tract").alias("tract_count"),
        F.mode("performance_tier", True).alias("avg_performance_tier"))
    return (trend.join(info, "market_segment")
                 .select("market_segment",
                         F.when(F.col("n_years") > 1, F.coalesce(F.col("volume_trend_pct"), F.lit(0.0)))
                          .otherwise(F.lit(0.0)).alias("volume_trend_pct"),
                         F.when(F.col("n_years") > 1, F.coalesce(F.col("approval_rate_trend"), F.lit(0.0)))
                          .otherwise(F.lit(0.0)).alias("approval_rate_trend"),
                         "tract_count", "avg_performance_tier"))


def market_year(metrics: DataFrame) -> DataFrame:
    """F5 (first level): market totals per year, 2 dp."""
    return (metrics.groupBy("year")
                   .agg(F.sum("total_applications").cast("bigint").alias("total_applications"),
                        F.sum("total_originations").cast("bigint").alias("total_originations"),
                        F.round(F.avg("approval_rate"), 2).alias("approval_rate"),
                        F.round(F.avg("avg_loan_amount"), 2).alias("avg_loan_amount"),
                        F.round(F.avg("avg_income"), 2).alias("avg_income"),
                        F.round(F.avg("avg_dti"), 2).alias("avg_dti"),
                        F.round(F.sum("total_loan_volume"), 2).alias("total_loan_volume")))


VOLUME_METRICS = ["total_applications", "total_originations", "total_loan_volume"]
RATE_METRICS = ["approval_rate", "avg_loan_amount", "avg_income", "avg_dti"]


def market_trends(metrics: DataFrame) -> DataFrame:
    """one row of trends; pct change mean x 100 for volumes, mean diff for rates.

    The year table has one row per year, so its single-partition window is
    bounded by the number of years, not by the data.
    """
    my = market_year(metrics).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy("year")
    exprs = []
    for m in VOLUME_METRICS:
        p = F.lag(m).over(w)
        exprs.append(F.try_divide((F.col(m) - p).cast("double"), p.cast("double")).alias(m))
    for m in RATE_METRICS:
        exprs.append((F.col(m) - F.lag(m).over(w)).alias(m))
    steps = my.select("year", *exprs)
    aggs = [F.count(F.lit(1)).alias("total_years")]
    aggs += [(F.avg(m) * 100).alias(f"{m}_trend") for m in VOLUME_METRICS]
    aggs += [F.avg(m).alias(f"{m}_trend") for m in RATE_METRICS]
    t = steps.agg(*aggs)
    cols = [F.col("total_years").cast("bigint").alias("total_years")]
    for m in VOLUME_METRICS + RATE_METRICS:
        cols.append(F.when(F.col("total_years") > 1, F.coalesce(F.col(f"{m}_trend"), F.lit(0.0)))
                     .otherwise(F.lit(0.0)).alias(f"{m}_trend"))
    return t.select(*cols)


def summary_stats(metrics: DataFrame) -> DataFrame:
    """one-row summary across all years."""
    return metrics.agg(
        F.count_distinct("census_tract").alias("total_census_tracts"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count_distinct("year").alias("years_analyzed"),
        F.sum("total_applications").cast("bigint").alias("total_applications_all_years"),
        F.avg("approval_rate").alias("avg_approval_rate_all_years"))


def distribution(metrics: DataFrame, col: str) -> DataFrame:
    """F6 frequency table (``value_counts``)."""
    return metrics.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def executive_summary(metrics: DataFrame) -> DataFrame:
    """period text, totals, rounded rates, trends and dominant segment."""
    s = summary_stats(metrics)
    t = market_trends(metrics)
    seg = distribution(metrics, "market_segment")
    dom = seg.agg(F.min_by("value", F.struct(-F.col("count"), F.col("value")))
                  .alias("dominant_market_segment"))
    return (s.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(dom))
             .select(F.concat_ws("-", F.col("first_year").cast("string"),
                                 F.col("last_year").cast("string")).alias("analysis_period"),
                     F.col("total_census_tracts").alias("total_tracts_analyzed"),
                     F.col("total_applications_all_years").alias("total_loan_applications"),
                     half_up(F.col("avg_approval_rate_all_years"), 1).alias("overall_approval_rate"),
                     half_up(F.col("total_applications_trend"), 1).alias("volume_trend"),
                     half_up(F.col("approval_rate_trend"), 2).alias("approval_rate_trend"),
                     "dominant_market_segment"))


def growth_opportunities(metrics: DataFrame, **emerging) -> DataFrame:
    """I4: first 5 growth leaders tagged High, first 3 emerging markets tagged Moderate;
    ``emerging`` goes to ``emerging_markets``."""
    gl = growth_leaders(metrics).orderBy(F.desc("volume_growth_pct"), "census_tract").limit(5)
    em = emerging_markets(metrics, **emerging).orderBy(F.desc("volume_growth_pct"), "census_tract").limit(3)
    fmt = lambda c: F.concat(one_decimal(F.col(c)), F.lit("%"))
    a = gl.select(F.lit("High Growth Leader").alias("type"), "census_tract",
                  fmt("volume_growth_pct").alias("volume_growth"),
                  fmt("current_approval_rate").alias("approval_rate"), "market_segment",
                  F.lit("High").alias("opportunity_score"))
    b = em.select(F.lit("Emerging Market").alias("type"), "census_tract",
                  fmt("volume_growth_pct").alias("volume_growth"),
                  fmt("current_approval_rate").alias("approval_rate"), "market_segment",
                  F.lit("Moderate").alias("opportunity_score"))
    return a.unionByName(b)


def risk_alerts(changes: DataFrame, k: int = 5, high_drop: float = -10.0) -> DataFrame:
    """The k worst decliners; High risk if approval fell by more than 10 points."""
    d = top_movers(changes).filter((F.col("direction") == "decliner") & (F.col("rank") <= k))
    fmt = lambda c: F.concat(one_decimal(F.col(c)), F.lit("%"))
    return d.select(F.lit("Declining Performance").alias("type"), "census_tract", "rank",
                    fmt("volume_change_pct").alias("volume_change"),
                    fmt("approval_rate_change").alias("approval_rate_change"),
                    fmt("current_approval_rate").alias("current_approval_rate"),
                    "market_segment",
                    F.when(F.col("approval_rate_change") < high_drop, "High")
                     .otherwise("Moderate").alias("risk_level"))


def insight_splits(opportunities: DataFrame, risks: DataFrame, trends: DataFrame) -> DataFrame:
    """growth opportunities by type, risks by level, and the trends of each segment, as one
    table ``(section, split, key, market_segment, volume, approval, detail)`` of texts."""
    def rows(df: DataFrame, section: str, split: str, key: str, volume: Column, approval: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(split).alias("split"), F.col(key).alias("key"), "market_segment",
                         volume.alias("volume"), approval.alias("approval"), detail.alias("detail"))

    percent = lambda c: F.concat(one_decimal(F.col(c)), F.lit("%"))
    return (rows(opportunities, "opportunity", "type", "census_tract", F.col("volume_growth"), F.col("approval_rate"), F.lit(None).cast("string"))
            .unionByName(rows(risks, "risk", "risk_level", "census_tract", F.col("volume_change"), F.col("approval_rate_change"), F.col("current_approval_rate")))
            .unionByName(rows(trends, "trend", "avg_performance_tier", "market_segment", percent("volume_trend_pct"), percent("approval_rate_trend"),
                              F.col("tract_count").cast("string"))))


# Fixed recommendation texts of the reference.
REC_GROWTH = "📈 Market is experiencing strong growth - consider expanding origination capacity"
REC_DECLINE = "📉 Market volume declining - investigate competitive pressures and rate sensitivity"
REC_APPROVAL_DOWN = "⚠️ Approval rates declining - review underwriting criteria and credit policies"
REC_APPROVAL_UP = "✅ Approval rates improving - good sign of market health and process optimization"
REC_LUXURY = "💎 Luxury segment showing strong growth - consider premium product offerings"
REC_AFFORDABLE = "🏠 Affordable segment approval rates declining - review FHA/VA programs"
REC_LEADERS = "🎯 {n} high-growth census tracts identified - prioritize these for business development"


def strategic_recommendations(metrics: DataFrame) -> DataFrame:
    """Ordered recommendation list, one row per recommendation."""
    t = market_trends(metrics)
    seg = segment_trends(metrics)
    lux = seg.agg(F.max(F.when(F.col("market_segment") == "Luxury", F.col("volume_trend_pct"))).alias("lux"),
                  F.min(F.when(F.col("market_segment") == "Affordable",
                               F.col("approval_rate_trend"))).alias("aff"))
    n_lead = growth_leaders(metrics).agg(F.count(F.lit(1)).alias("n_lead"))
    v, a = F.col("total_applications_trend"), F.col("approval_rate_trend")
    recs = F.array_compact(F.array(
        F.when(v > 10, F.lit(REC_GROWTH)).when(v < -10, F.lit(REC_DECLINE)),
        F.when(a < -2, F.lit(REC_APPROVAL_DOWN)).when(a > 2, F.lit(REC_APPROVAL_UP)),
        F.when(F.col("lux") > 15, F.lit(REC_LUXURY)),
        F.when(F.col("aff") < -5, F.lit(REC_AFFORDABLE)),
        F.when(F.col("n_lead") > 5, F.replace(F.lit(REC_LEADERS), F.lit("{n}"),
                                              F.col("n_lead").cast("string")))))
    one = t.crossJoin(F.broadcast(lux)).crossJoin(F.broadcast(n_lead)).select(recs.alias("r"))
    return one.select(F.posexplode("r").alias("position", "recommendation")) \
              .select(F.col("position").cast("int").alias("position"), "recommendation")
