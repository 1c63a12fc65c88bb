"""Tract master dataset and opportunity score (SURVEY P2: C2, C3, F1, F2, G1,
G2, G4, H6, E1-E6, E10, F8, I6, C14, K3, K4, F12).

Plan shape: one hash aggregate of the applications by tract (partial
aggregation on the map side), then everything runs on the tract table.  The
census join is an equi-join on the tract key left to AQE (census grows with
the number of tracts, so it is not hinted); global statistics for the min-max
scores are one one-row aggregate broadcast back (``crossJoin`` of a single
row, a proven size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlens.functions import parse
from tractlens.functions.columns import div, nan_mean, round2
from tractlens.functions.stats import grouped_agg_with_medians

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
OPPORTUNITY_WEIGHTS = {"market_accessibility": 0.30, "risk_factors": 0.25,
                       "economic_indicators": 0.25, "lending_activity": 0.20}
LEVEL_HIGH, LEVEL_MEDIUM = 75, 50
NEUTRAL_SCORE = 50.0
# Component recipes: (input column, weight, higher is better).
ACCESSIBILITY = [("total_population", 0.4, True), ("median_household_income", 0.35, True),
                 ("loan_count", 0.25, True)]
RISK = [("unemployment_rate", 0.4, False), ("avg_dti", 0.35, False), ("denial_rate", 0.25, False)]
ECONOMIC = [("median_household_income", 0.4, True), ("civilian_labor_force", 0.35, True),
            ("annual_change", 0.25, True)]
ACTIVITY = [("loan_count", 0.4, True), ("avg_loan_amount", 0.35, True), ("approval_rate", 0.25, True)]
DEFAULT_MODE_ACTION = 3
# Business segments (K3/K4).
SEGMENT_QUANTILES = (0.33, 0.67)
STRATEGIES = [("High Income, Low Risk", "🎯 Prime Target - Aggressive Expansion"),
              ("High Income+Medium Risk", "📈 Growth Focus - Selective Expansion"),
              ("Medium Income, Low Risk", "🏦 Core Market - Steady Growth"),
              ("Low Risk", "✅ Stable Market - Maintain Presence"),
              ("High Risk", "⚠️ Caution - Limited Exposure")]
STRATEGY_DEFAULT = "📊 Standard Market - Balanced Approach"
# ---------------------------------------------------------------------------


def clean_applications(apps: DataFrame) -> DataFrame:
    """C2 + C3: normalised tract key, null/'NA' tracts dropped, action in 1..8."""
    return (apps.withColumn("census_tract", parse.tract_key(F.col("census_tract")))
                .filter(F.col("census_tract").isNotNull() & parse.valid_action(F.col("action_taken"))))


def _mode_action(action: Column) -> Column:
    return F.coalesce(F.mode(action, True), F.lit(DEFAULT_MODE_ACTION))


def tract_rollup_v2(apps: DataFrame) -> DataFrame:
    """per tract counts, means, medians, approval (1,2,6,8) and denial (3)
    rates as fractions, modal action; all 2 dp.  DTI/LTV are plain numeric
    coercions of the raw text (as in the platform code)."""
    a = clean_applications(apps).select(
        "census_tract", F.col("loan_amount").cast("double").alias("loan_amount"),
        parse.to_number(F.col("income")).alias("income"),
        parse.to_number(F.col("debt_to_income_ratio")).alias("dti"),
        parse.to_number(F.col("loan_to_value_ratio")).alias("ltv"),
        parse.approved_broad(F.col("action_taken")).alias("approved"),
        parse.denied_strict(F.col("action_taken")).alias("denied"),
        "action_taken")
    g = grouped_agg_with_medians(
        a, ["census_tract"],
        [F.count("loan_amount").alias("loan_count"), F.avg("loan_amount").alias("avg_loan_amount"),
         F.avg("income").alias("avg_income"), F.avg("dti").alias("avg_dti"),
         F.avg("ltv").alias("avg_ltv"), F.sum("approved").alias("total_approved"),
         F.avg("approved").alias("approval_rate"), F.sum("denied").alias("total_denied"),
         F.avg("denied").alias("denial_rate"), _mode_action(F.col("action_taken")).alias("most_common_action")],
        {"median_loan_amount": F.col("loan_amount"), "median_income": F.col("income")})
    return g.select(
        "census_tract", F.col("loan_count").cast("bigint").alias("loan_count"),
        round2(F.col("avg_loan_amount")).alias("avg_loan_amount"),
        round2(F.col("median_loan_amount")).alias("median_loan_amount"),
        round2(F.col("avg_income")).alias("avg_income"),
        round2(F.col("median_income")).alias("median_income"),
        round2(F.col("avg_dti")).alias("avg_dti"), round2(F.col("avg_ltv")).alias("avg_ltv"),
        F.col("total_approved").cast("bigint").alias("total_approved"),
        round2(F.col("approval_rate")).alias("approval_rate"),
        F.col("total_denied").cast("bigint").alias("total_denied"),
        round2(F.col("denial_rate")).alias("denial_rate"),
        F.col("most_common_action").cast("int").alias("most_common_action"))


def tract_rollup_v1(apps: DataFrame) -> DataFrame:
    """F1 (tract pipeline): DTI by parser v1, LTV by parser v1, approval
    {1,2,6,8} / denial {3,7}; DTI named ``avg_debt_to_income_ratio`` (trap T11)."""
    a = clean_applications(apps).select(
        "census_tract", F.col("loan_amount").cast("double").alias("loan_amount"),
        parse.to_number(F.col("income")).alias("income"),
        parse.dti_v1(F.col("debt_to_income_ratio")).alias("dti"),
        parse.ltv_v1(F.col("loan_to_value_ratio")).alias("ltv"),
        parse.approved_broad(F.col("action_taken")).alias("approved"),
        parse.denied_broad(F.col("action_taken")).alias("denied"),
        "action_taken")
    g = grouped_agg_with_medians(
        a, ["census_tract"],
        [F.count("loan_amount").alias("loan_count"), F.avg("loan_amount").alias("avg_loan_amount"),
         F.avg("income").alias("avg_income"), F.avg("dti").alias("avg_debt_to_income_ratio"),
         F.avg("ltv").alias("avg_loan_to_value_ratio"), F.sum("approved").alias("total_approved"),
         F.avg("approved").alias("approval_rate"), F.sum("denied").alias("total_denied"),
         F.avg("denied").alias("denial_rate"), _mode_action(F.col("action_taken")).alias("most_common_action")],
        {"median_loan_amount": F.col("loan_amount"), "median_applicant_income": F.col("income")})
    out = []
    for f in g.schema.fields:
        c = F.col(f.name)
        if f.name in ("census_tract",):
            out.append(c)
        elif f.name in ("loan_count", "total_approved", "total_denied"):
            out.append(c.cast("bigint").alias(f.name))
        elif f.name == "most_common_action":
            out.append(c.cast("int").alias(f.name))
        else:
            out.append(round2(c).alias(f.name))
    return g.select(*out)


def census_with_rates(census: DataFrame) -> DataFrame:
    """Unemployment rate (2 dp) from unemployed / labour force."""
    return census.withColumn("unemployment_rate",
                             parse.unemployment_rate(F.col("unemployed"), F.col("civilian_labor_force")))


def hpi_with_change(hpi: DataFrame) -> DataFrame:
    """annual_change = percent change of hpi from the tract's previous present year."""
    w = Window.partitionBy("census_tract").orderBy("year")
    prev = F.lag("hpi").over(w)
    return hpi.withColumn("annual_change", div(F.col("hpi") - prev, prev) * 100)


def latest_per_tract(df: DataFrame, cols: list[str], order: str = "year") -> DataFrame:
    """H6: the row of the latest ``order`` per tract (``idxmax``) as one aggregate."""
    s = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy("census_tract").agg(F.max_by(s, F.col(order)).alias("_l"))
              .select("census_tract", *[F.col(f"_l.{c}").alias(c) for c in cols]))


def master_dataset(apps: DataFrame, census: DataFrame, hpi: DataFrame | None) -> DataFrame:
    """F2 -> G1 (inner, census) -> G2 (left, latest HPI)."""
    m = tract_rollup_v2(apps).join(census_with_rates(census), "census_tract", "inner")
    if hpi is not None:
        m = m.join(latest_per_tract(hpi_with_change(hpi), ["hpi", "annual_change"]),
                   "census_tract", "left")
    return m


def _component(df_cols: set[str], recipe, stats_prefix: str = "_s") -> Column:
    """Weighted min-max component; a missing input counts as the neutral 50;
    a null result (any null input) becomes 50, as ``fillna(50)``."""
    total = None
    for c, w, higher in recipe:
        if c in df_cols:
            x = F.col(c).cast("double")
            mn, mx, cnt = F.col(f"{stats_prefix}_min_{c}"), F.col(f"{stats_prefix}_max_{c}"), F.col(f"{stats_prefix}_n_{c}")
            norm = (x - mn) / (mx - mn) * 100
            val = norm if higher else F.lit(100.0) - norm
            score = F.when(cnt == 0, F.lit(NEUTRAL_SCORE)).when(mn == mx, F.lit(NEUTRAL_SCORE)).otherwise(val)
        else:
            score = F.lit(NEUTRAL_SCORE)
        term = score * F.lit(w)
        total = term if total is None else total + term
    return F.coalesce(total, F.lit(NEUTRAL_SCORE))


def normalize_to_100(df: DataFrame, col: str, higher_better: bool = True, out: str | None = None) -> DataFrame:
    """E1 on its own: global min-max to 0..100 (50 when constant or all null)."""
    st = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"), F.count(col).alias("_n"))
    x = F.col(col).cast("double")
    norm = (x - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * 100
    val = norm if higher_better else F.lit(100.0) - norm
    return (df.crossJoin(F.broadcast(st))
              .withColumn(out or f"{col}_score",
                          F.when(F.col("_n") == 0, F.lit(NEUTRAL_SCORE))
                           .when(F.col("_mn") == F.col("_mx"), F.lit(NEUTRAL_SCORE)).otherwise(val))
              .drop("_mn", "_mx", "_n"))


def opportunity_score(master: DataFrame) -> DataFrame:
    """Four components and the weighted score with its level."""
    cols = set(master.columns)
    needed = sorted({c for rec in (ACCESSIBILITY, RISK, ECONOMIC, ACTIVITY) for c, _, _ in rec} & cols)
    stats = master.agg(*[e for c in needed for e in (
        F.min(F.col(c).cast("double")).alias(f"_s_min_{c}"), F.max(F.col(c).cast("double")).alias(f"_s_max_{c}"),
        F.count(c).alias(f"_s_n_{c}"))])
    scored = (master.crossJoin(F.broadcast(stats))
                    .withColumn("market_accessibility", _component(cols, ACCESSIBILITY))
                    .withColumn("risk_factors", _component(cols, RISK))
                    .withColumn("economic_indicators", _component(cols, ECONOMIC))
                    .withColumn("lending_activity", _component(cols, ACTIVITY)))
    w = OPPORTUNITY_WEIGHTS
    score = round2(F.col("market_accessibility") * w["market_accessibility"]
                   + F.col("risk_factors") * w["risk_factors"]
                   + F.col("economic_indicators") * w["economic_indicators"]
                   + F.col("lending_activity") * w["lending_activity"])
    return (scored.drop(*[c for c in scored.columns if c.startswith("_s_")])
                  .withColumn("opportunity_score", score)
                  .withColumn("opportunity_level", opportunity_level(F.col("opportunity_score"))))


def opportunity_level(score: Column) -> Column:
    return F.when(score >= LEVEL_HIGH, "High").when(score >= LEVEL_MEDIUM, "Medium").otherwise("Low")


def scored_summary(scored: DataFrame) -> DataFrame:
    """F8: KPI row."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_census_tracts"),
        F.avg("opportunity_score").alias("average_opportunity_score"),
        F.sum("total_population").cast("bigint").alias("total_population"),
        (F.count_if(F.col("opportunity_level") == "High") / F.count(F.lit(1)) * 100).alias("high_share_pct"),
        F.count_if(F.col("opportunity_level") == "High").alias("high_count"),
        F.count_if(F.col("opportunity_level") == "Medium").alias("medium_count"),
        F.count_if(F.col("opportunity_level") == "Low").alias("low_count"))


def top_markets(scored: DataFrame, k: int = 10) -> DataFrame:
    """Top k tracts by score (ties by tract id)."""
    return (scored.orderBy(F.desc("opportunity_score"), "census_tract").limit(k)
                  .select("census_tract", "opportunity_score", "opportunity_level", "total_population",
                          "loan_count", "approval_rate"))


def key_overlap(a: DataFrame, b: DataFrame, key: str = "census_tract") -> DataFrame:
    """Sizes of the two key sets and of their intersection (one full outer join)."""
    ka = a.select(F.col(key)).distinct().withColumn("_a", F.lit(1))
    kb = b.select(F.col(key)).distinct().withColumn("_b", F.lit(1))
    j = ka.join(kb, key, "full_outer")
    return j.agg(F.count("_a").alias("left_keys"), F.count("_b").alias("right_keys"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlap_keys"))


def filter_tracts(scored: DataFrame, levels: list[str] | None = None,
                  score_range: tuple[float, float] = (0, 100),
                  pop_range: tuple[float, float] | None = None) -> DataFrame:
    """C14: conjunction of inclusive filters; count, average score, population."""
    cond = F.col("opportunity_score").between(*score_range)
    if levels:
        cond = cond & F.col("opportunity_level").isin(levels)
    if pop_range:
        cond = cond & F.col("total_population").between(*pop_range)
    return scored.filter(cond).agg(
        F.count(F.lit(1)).alias("tract_count"), F.avg("opportunity_score").alias("avg_score"),
        F.sum("total_population").cast("bigint").alias("total_population"))


def business_risk_score(df: DataFrame) -> Column:
    """Row mean of unemployment rate and denial rate x 100 (nulls skipped);
    without either column, 100 - opportunity score."""
    parts = []
    if "unemployment_rate" in df.columns:
        parts.append(F.col("unemployment_rate").cast("double"))
    if "denial_rate" in df.columns:
        parts.append(F.col("denial_rate").cast("double") * 100)
    if not parts:
        return F.lit(100.0) - F.col("opportunity_score")
    return nan_mean(parts) if len(parts) > 1 else parts[0]


def business_segments(scored: DataFrame, exact: bool = True) -> DataFrame:
    """K3: 3 x 3 income / risk segment from the 33rd and 67th percentiles.

    The percentiles run over the tract table (one row per tract), a bounded
    input; ``exact=False`` switches to the ``percentile_approx`` sketch.
    """
    df = scored.withColumn("_risk", business_risk_score(scored))
    q = F.array(*[F.lit(p) for p in SEGMENT_QUANTILES])
    agg = (F.percentile(F.col("median_household_income").cast("double"), q) if exact
           else F.percentile_approx(F.col("median_household_income").cast("double"), q, 100000))
    ragg = (F.percentile(F.col("_risk"), q) if exact else F.percentile_approx(F.col("_risk"), q, 100000))
    st = df.agg(agg.alias("_iq"), ragg.alias("_rq"))
    inc, risk = F.col("median_household_income"), F.col("_risk")
    income_level = (F.when(inc >= F.col("_iq")[1], "High Income").when(inc >= F.col("_iq")[0], "Medium Income")
                     .otherwise("Lower Income"))
    risk_level = (F.when(risk <= F.col("_rq")[0], "Low Risk").when(risk <= F.col("_rq")[1], "Medium Risk")
                   .otherwise("High Risk"))
    return (df.crossJoin(F.broadcast(st))
              .withColumn("business_segment", F.concat_ws(", ", income_level, risk_level))
              .withColumnRenamed("_risk", "business_risk_score")
              .drop("_iq", "_rq"))


def segment_strategy(segment: Column) -> Column:
    """K4: text rules on the segment label, first match wins."""
    out = F.when(segment.contains("High Income, Low Risk"), STRATEGIES[0][1])
    out = out.when(segment.contains("High Income") & segment.contains("Medium Risk"), STRATEGIES[1][1])
    for needle, text in STRATEGIES[2:]:
        out = out.when(segment.contains(needle), text)
    return out.otherwise(STRATEGY_DEFAULT)


def business_segment_stats(segmented: DataFrame) -> DataFrame:
    """per business segment mean / std / min / max / count of the score,
    population sum and the K4 strategy."""
    return (segmented.groupBy("business_segment")
                     .agg(F.avg("opportunity_score").alias("avg_score"),
                          F.stddev_samp("opportunity_score").alias("std_score"),
                          F.min("opportunity_score").alias("min_score"),
                          F.max("opportunity_score").alias("max_score"),
                          F.count(F.lit(1)).alias("tract_count"),
                          F.sum("total_population").cast("bigint").alias("total_population"))
                     .withColumn("strategy", segment_strategy(F.col("business_segment"))))

