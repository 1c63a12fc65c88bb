"""Temporal scoring and forecast inputs (SURVEY E7-E9, H2-H5, H7-H9, H11-H13,
L7, L9, L10 expressions, F13, F16, F17, I7, I8, J2).

Everything after ``yearly_tract_scores`` runs on the tract x year table.
Windows partition by tract; the few global scalars (maximum of a feature,
latest year) are one-row aggregates joined back by broadcast.  Forecast
horizons are a tiny literal table joined by broadcast, never a Python loop
over years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlens.functions import parse
from tractlens.functions.columns import clip, null_d, round2
from tractlens.functions.stats import grouped_agg_with_medians

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
MIN_APPLICATIONS = 5
SCORE_WEIGHTS = {"lending_activity": 0.30, "approval_rate": 0.25, "market_accessibility": 0.20,
                 "economic_indicators": 0.15, "risk_factors": 0.10}
ACTIVITY_FULL_AT = 50          # applications for a full activity score
LOAN_FULL_AT = 500000          # median loan for a full accessibility score
INCOME_FULL_AT = 150           # median income (thousands) for a full economic score
DTI_PENALTY = 1.5
NEUTRAL = 50.0
TEMPORAL_FEATURES = ["opportunity_score", "lending_activity", "approval_rate", "market_accessibility",
                     "economic_indicators", "risk_factors"]
PROGRESSION_FEATURES = ["lending_activity", "approval_rate", "market_accessibility", "economic_indicators",
                        "opportunity_score"]
TREND_THRESHOLD = 2.0
DAMPING = 0.8
CONFIDENCE_BASE, CONFIDENCE_STEP, CONFIDENCE_STRENGTH = 85, 5, 10
CONFIDENCE_RANGE = (60, 95)
ECONOMIC_GROWTH = {"income_growth": 0.025, "population_growth": 0.008, "unemployment_change": -0.02}
HORIZON_DAMPING = 0.1
UNEMPLOYMENT_CAP = 25
ASSESSMENTS = [(80, "Excellent opportunity zone with strong fundamentals across all metrics"),
               (65, "Good opportunity zone with solid performance in most areas"),
               (50, "Moderate opportunity zone with balanced risk-reward profile"),
               (35, "Emerging opportunity zone with potential for growth")]
ASSESSMENT_DEFAULT = "Developing opportunity zone requiring strategic focus"
# ---------------------------------------------------------------------------


def yearly_tract_scores(apps: DataFrame, year_col: str = "activity_year",
                        min_applications: int = MIN_APPLICATIONS) -> DataFrame:
    """E7 + E9: per (tract, year) HMDA opportunity score with its five components.

    One aggregate on (tract, year); the three medians use the skew-safe helper.
    DTI uses parser v3 (labels only; plain numeric text is ignored).
    """
    a = (apps.filter(F.col("census_tract").isNotNull())
             .select(F.col("census_tract").cast("string").alias("census_tract"),
                     F.col(year_col).cast("int").alias("year"), "action_taken",
                     parse.to_number(F.col("loan_amount")).alias("loan"),
                     parse.to_number(F.col("income")).alias("inc"),
                     parse.dti_v3(F.col("debt_to_income_ratio")).alias("dti")))
    g = grouped_agg_with_medians(
        a, ["census_tract", "year"],
        [F.count(F.lit(1)).alias("total_applications"),
         F.count_if(F.col("action_taken") == 1).alias("_orig")],
        {"_med_loan": F.col("loan"), "_med_inc": F.col("inc"), "_med_dti": F.col("dti")})
    g = g.filter(F.col("total_applications") >= min_applications)
    n = F.col("total_applications")
    la = F.least(F.lit(100.0), n / ACTIVITY_FULL_AT * 100)
    ar = F.col("_orig") / n * 100
    # Python's min(100, nan) returns 100: a missing median scores full.
    ma = F.when(F.col("_med_loan").isNull(), F.lit(100.0)).otherwise(
        F.least(F.lit(100.0), F.col("_med_loan") / LOAN_FULL_AT * 100))
    ec = F.when(F.col("_med_inc").isNull(), F.lit(100.0)).otherwise(
        F.least(F.lit(100.0), F.col("_med_inc") / INCOME_FULL_AT * 100))
    rs = F.when(F.col("_med_dti").isNull(), F.lit(NEUTRAL)).otherwise(
        F.greatest(F.lit(0.0), F.lit(100.0) - F.col("_med_dti") * DTI_PENALTY))
    g = g.withColumns({"_la": la, "_ar": ar, "_ma": ma, "_ec": ec, "_rs": rs})
    w = SCORE_WEIGHTS
    raw = (F.col("_la") * w["lending_activity"] + F.col("_ar") * w["approval_rate"]
           + F.col("_ma") * w["market_accessibility"] + F.col("_ec") * w["economic_indicators"]
           + F.col("_rs") * w["risk_factors"])
    return g.select(
        "census_tract", "year", F.col("total_applications").cast("bigint").alias("total_applications"),
        round2(raw).alias("opportunity_score"),
        round2(F.col("_la")).alias("lending_activity"), round2(F.col("_ar")).alias("approval_rate"),
        round2(F.col("_ma")).alias("market_accessibility"), round2(F.col("_ec")).alias("economic_indicators"),
        round2(F.col("_rs")).alias("risk_factors"),
        F.col("_med_loan").alias("avg_loan_amount"), F.col("_med_inc").alias("avg_income"),
        F.coalesce(F.col("_med_dti"), F.lit(0.0)).alias("avg_dti"),
        raw.alias("_raw_score"))


def score_reasoning(scores: DataFrame) -> DataFrame:
    """Banded explanation texts and key factors as a nested struct column."""
    n, ar = F.col("total_applications"), F.col("approval_rate")
    loan, inc, dti = F.col("avg_loan_amount"), F.col("avg_income"), F.col("avg_dti")
    act = (F.when(n >= 50, F.format_string("High lending activity with %d applications (excellent market demand)", n))
            .when(n >= 25, F.format_string("Moderate lending activity with %d applications (good market interest)", n))
            .when(n >= 10, F.format_string("Limited lending activity with %d applications (emerging market)", n))
            .otherwise(F.format_string("Low lending activity with only %d applications (underdeveloped market)", n)))
    appr = (F.when(ar >= 80, F.format_string("Excellent approval rate of %.1f%% indicates strong creditworthiness", ar))
             .when(ar >= 60, F.format_string("Good approval rate of %.1f%% shows moderate lending success", ar))
             .when(ar >= 40, F.format_string("Fair approval rate of %.1f%% suggests some lending challenges", ar))
             .otherwise(F.format_string("Low approval rate of %.1f%% indicates significant lending barriers", ar)))
    money = F.concat(F.lit("$"), F.format_number(loan, 0))
    acc = (F.when(loan >= 400000, F.format_string("High-value market with median loan of %s (premium segment)", money))
            .when(loan >= 250000, F.format_string("Mid-range market with median loan of %s (mainstream segment)", money))
            .when(loan >= 150000, F.format_string("Affordable market with median loan of %s (entry-level segment)", money))
            .otherwise(F.format_string("Low-value market with median loan of %s (budget segment)", money)))
    eco = (F.when(inc >= 120, F.format_string("High-income area with median income $%.0fk (strong economic foundation)", inc))
            .when(inc >= 80, F.format_string("Middle-income area with median income $%.0fk (stable economic base)", inc))
            .when(inc >= 50, F.format_string("Moderate-income area with median income $%.0fk (developing economic base)", inc))
            .otherwise(F.format_string("Low-income area with median income $%.0fk (economic growth potential)", inc)))
    risk = (F.when(dti <= 0, F.lit("Risk assessment based on standard lending criteria (limited DTI data)"))
             .when(dti <= 25, F.format_string("Low risk profile with median DTI of %.1f%% (excellent financial health)", dti))
             .when(dti <= 35, F.format_string("Moderate risk profile with median DTI of %.1f%% (good financial stability)", dti))
             .when(dti <= 50, F.format_string("Higher risk profile with median DTI of %.1f%% (manageable debt levels)", dti))
             .otherwise(F.format_string("High risk profile with median DTI of %.1f%% (elevated debt burden)", dti)))
    s = F.col("_raw_score")
    assess = None
    for lim, text in ASSESSMENTS:
        assess = F.when(s >= lim, text) if assess is None else assess.when(s >= lim, text)
    assess = assess.otherwise(ASSESSMENT_DEFAULT)

    def comp(score: str, weight: str, text: Column) -> Column:
        return F.struct(F.col(score).alias("score"), F.lit(weight).alias("weight"), text.alias("reasoning"))

    def pts(c: str, w: float) -> Column:
        return F.format_string("%s", F.round(F.col(c) * w, 1))

    key = F.array(
        F.concat(F.lit("Lending activity contributes "), pts("lending_activity", .30), F.lit(" points (30% weight)")),
        F.concat(F.lit("Approval rate contributes "), pts("approval_rate", .25), F.lit(" points (25% weight)")),
        F.concat(F.lit("Market accessibility contributes "), pts("market_accessibility", .20), F.lit(" points (20% weight)")),
        F.concat(F.lit("Economic indicators contribute "), pts("economic_indicators", .15), F.lit(" points (15% weight)")),
        F.concat(F.lit("Risk factors contribute "), pts("risk_factors", .10), F.lit(" points (10% weight)")))
    reasoning = F.struct(
        F.col("opportunity_score").alias("overall_score"), assess.alias("assessment"),
        F.struct(comp("lending_activity", "30%", act).alias("lending_activity"),
                 comp("approval_rate", "25%", appr).alias("approval_rate"),
                 comp("market_accessibility", "20%", acc).alias("market_accessibility"),
                 comp("economic_indicators", "15%", eco).alias("economic_indicators"),
                 comp("risk_factors", "10%", risk).alias("risk_factors")).alias("components"),
        key.alias("key_factors"),
        F.lit("Weighted average of five key lending opportunity components").alias("calculation_method"))
    return scores.withColumn("reasoning", reasoning)


def _ffill_within(col: str, w: Window) -> Column:
    return F.last(F.col(col), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def temporal_features(scores: DataFrame, base_year: int | None = None, year_span: float = 2.0,
                      features: Sequence[str] = TEMPORAL_FEATURES) -> DataFrame:
    """H2-H5 + H8: per tract (>= 2 years) lag 1, diff, pct change, 2-year moving
    average and normalised year; missing values forward-filled *within* the
    tract then 0 (trap T4 fixed); +-inf -> 0.  ``base_year`` defaults to the
    first year in the data (the reference hard-codes 2022)."""
    w = Window.partitionBy("census_tract").orderBy("year")
    wt = Window.partitionBy("census_tract")
    s = scores.withColumn("_n_years", F.count(F.lit(1)).over(wt)).filter(F.col("_n_years") >= 2).drop("_n_years")
    cols = {}
    for c in features:
        prev = F.lag(c, 1).over(w)
        x = F.col(c)
        cols[f"{c}_lag1"] = prev
        cols[f"{c}_yoy_change"] = x - prev
        inf = F.lit(float("inf"))
        cols[f"{c}_yoy_pct_change"] = (
            F.when(prev.isNull(), null_d())
             .when(prev == 0, F.when(x > 0, inf).when(x < 0, -inf).otherwise(null_d()))
             .otherwise((x - prev) / prev))
        cols[f"{c}_ma2"] = F.avg(x).over(w.rowsBetween(-1, 0))
    out = s.withColumns(cols)
    if base_year is None:
        out = out.crossJoin(F.broadcast(scores.agg(F.min("year").alias("_base"))))
        base = F.col("_base")
    else:
        base = F.lit(base_year)
    out = out.withColumn("year_normalized", (F.col("year") - base) / year_span)
    filled = {c: F.coalesce(_ffill_within(c, w), F.lit(0.0)) for c in cols}
    out = out.withColumns(filled)
    out = out.withColumns({c: F.when(F.abs(F.col(c)) == float("inf"), F.lit(0.0)).otherwise(F.col(c)) for c in cols})
    return out.drop("_base") if base_year is None else out


def tract_trends(scores: DataFrame, score_col: str = "opportunity_score") -> DataFrame:
    """H9: average year-on-year change, population std of the changes,
    direction (+-2) and strength (share of the dominant sign)."""
    w = Window.partitionBy("census_tract").orderBy("year")
    d = scores.select("census_tract", (F.col(score_col) - F.lag(score_col).over(w)).alias("d"))
    g = d.groupBy("census_tract").agg(
        F.count("d").alias("n"), F.avg("d").alias("avg_d"), F.stddev_pop("d").alias("sd"),
        F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"))
    avg = F.when(F.col("n") > 0, F.col("avg_d")).otherwise(F.lit(0.0))
    return g.select(
        "census_tract",
        F.when(avg > TREND_THRESHOLD, "increasing").when(avg < -TREND_THRESHOLD, "decreasing")
         .otherwise("stable").alias("trend_direction"),
        avg.alias("avg_yoy_change"),
        F.when(F.col("n") > 1, F.greatest("pos", "neg") / F.col("n")).otherwise(F.lit(0.5)).alias("trend_strength"),
        F.when(F.col("n") > 1, F.col("sd")).otherwise(F.lit(0.0)).alias("volatility"))


def horizons(spark, years: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(int(y),) for y in years], "pred_year int")


def temporal_progression(features: DataFrame, trends: DataFrame, pred_years: Sequence[int],
                         base_year: int | None = None, year_span: float = 4.0) -> DataFrame:
    """Future feature rows per (tract, prediction year) from the latest
    year's rows, damped trend progression (0.8^h), clipped; lag/MA = value;
    yoy = avg change x damping; year_normalized over the extended span."""
    spark = features.sparkSession
    recent = features.agg(F.max("year").alias("_recent"))
    base = features.join(F.broadcast(recent), F.col("year") == F.col("_recent")).drop("_recent")
    maxes = base.agg(*[F.max(F.coalesce(F.col(c), F.lit(0.0))).alias(f"_max_{c}") for c in PROGRESSION_FEATURES])
    hz = horizons(spark, pred_years).crossJoin(recent)
    hz = hz.withColumn("years_ahead", F.col("pred_year") - F.col("_recent")).drop("_recent")
    out = (base.join(trends, "census_tract", "left")
               .crossJoin(F.broadcast(hz)).crossJoin(F.broadcast(maxes)))
    h = F.col("years_ahead")
    damp = F.pow(F.lit(DAMPING), h)
    prog = F.coalesce(F.col("avg_yoy_change"), F.lit(0.0)) * h * damp
    new = {}
    for c in PROGRESSION_FEATURES:
        b = F.coalesce(F.col(c), F.lit(0.0))
        if c == "opportunity_score":
            new[c] = clip(b + prog, 0, 100)
        elif c == "approval_rate":
            new[c] = clip(b + prog * 0.5, 0, 100)
        else:
            v = b + prog * 0.7
            hi = F.col(f"_max_{c}") * 1.5
            new[c] = F.when(v < 0, F.lit(0.0)).when(v > hi, hi).otherwise(v)
    out = out.withColumns(new)
    yr0 = F.lit(base_year) if base_year is not None else F.col("_base")
    if base_year is None:
        out = out.crossJoin(F.broadcast(features.agg(F.min("year").alias("_base"))))
    out = out.withColumn("year", F.col("pred_year")).withColumn("year_normalized", (F.col("pred_year") - yr0) / year_span)
    lag = {c: F.col(c[: -len("_lag1")]) for c in out.columns if c.endswith("_lag1") and c[: -len("_lag1")] in out.columns}
    yoy = {c: F.col("avg_yoy_change") * damp for c in out.columns
           if c.endswith("_yoy_change") and c[: -len("_yoy_change")] in out.columns}
    ma = {c: F.col(c[: -len("_ma2")]) for c in out.columns if c.endswith("_ma2") and c[: -len("_ma2")] in out.columns}
    out = out.withColumns({**lag, **yoy, **ma})
    return out.drop("pred_year", "_base", *[f"_max_{c}" for c in PROGRESSION_FEATURES],
                    "trend_direction", "volatility")


def prediction_confidence(years_ahead: Column, strength: Column) -> Column:
    """clip(85 - 5h + 10 * strength, 60, 95)."""
    return clip(F.lit(CONFIDENCE_BASE) - years_ahead * CONFIDENCE_STEP + strength * CONFIDENCE_STRENGTH,
                *CONFIDENCE_RANGE)


def confidence_band(score: Column, confidence: Column | None = None, width: float | None = None):
    """+-5 x (1 - conf/100) band, or a fixed +-10 band, clipped 0..100."""
    half = (F.lit(5.0) * (F.lit(1.0) - confidence / 100)) if confidence is not None else F.lit(float(width or 10))
    return clip(score - half, 0, 100), clip(score + half, 0, 100)


def economic_projection(latest: DataFrame, horizons_: Sequence[int] = (1, 2, 3, 5),
                        current_year: int | None = None) -> DataFrame:
    """Compound income / population growth and unemployment change per
    horizon, each rate damped by 1 / (1 + 0.1 h); unemployment clipped 0..25."""
    spark = latest.sparkSession
    hz = spark.createDataFrame([(int(h),) for h in horizons_], "years_ahead int")
    adj = F.lit(1.0) / (F.lit(1.0) + F.col("years_ahead") * HORIZON_DAMPING)
    g = ECONOMIC_GROWTH
    out = latest.crossJoin(F.broadcast(hz))
    h = F.col("years_ahead")
    out = out.withColumns({
        "median_household_income": F.col("median_household_income") * F.pow(1 + adj * g["income_growth"], h),
        "total_population": F.col("total_population") * F.pow(1 + adj * g["population_growth"], h),
        "unemployment_rate": clip(F.col("unemployment_rate") * (1 + adj * g["unemployment_change"]), 0, UNEMPLOYMENT_CAP),
    })
    if current_year is not None:
        out = out.withColumn("forecast_year", F.lit(current_year) + h)
    return out


def trend_by_yoy_mean(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Mean of all ``*_yoy_change`` columns; +-0.05 -> improving / declining / stable."""
    cols = [c for c in df.columns if c.endswith("_yoy_change")]
    if not cols:
        return df.withColumn("trend_direction", F.lit("stable"))
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    m = total / len(cols)
    return df.withColumn("avg_yoy_change_all", m).withColumn(
        "trend_direction", F.when(m > threshold, "improving").when(m < -threshold, "declining").otherwise("stable"))


def history_transition(history: DataFrame, predicted: DataFrame, score: str = "opportunity_score",
                       pred_score: str = "predicted_opportunity_score") -> DataFrame:
    """Historical trend class (mean diff > 2 significant, > 1 moderate) and
    the jump from the last historical to the first predicted score (> 5 major, > 2 moderate)."""
    w = Window.partitionBy("census_tract").orderBy("year")
    hist = (history.select("census_tract", "year", F.col(score).alias("s"),
                           (F.col(score) - F.lag(score).over(w)).alias("d"))
                   .groupBy("census_tract")
                   .agg(F.avg("d").alias("hist_trend"), F.max_by("s", "year").alias("last_hist")))
    first_pred = predicted.groupBy("census_tract").agg(F.min_by(pred_score, "year").alias("first_pred"))
    j = hist.join(first_pred, "census_tract", "inner")
    t, jump = F.coalesce(F.col("hist_trend"), F.lit(0.0)), F.col("first_pred") - F.col("last_hist")
    return j.select("census_tract", t.alias("historical_trend"),
                    F.when(F.abs(t) > 2, "significant").when(F.abs(t) > 1, "moderate").otherwise("stable")
                     .alias("historical_trend_class"),
                    jump.alias("transition"),
                    F.when(F.abs(jump) > 5, "major").when(F.abs(jump) > 2, "moderate").otherwise("smooth")
                     .alias("transition_class"))


def historical_predicted_timeline(history: DataFrame, predicted: DataFrame, score: str = "opportunity_score",
                                  pred_score: str = "predicted_opportunity_score") -> DataFrame:
    """One timeline of historical and predicted rows tagged by ``data_type``."""
    h = history.select("census_tract", "year", F.col(score).alias("score"), F.lit("historical").alias("data_type"))
    p = predicted.select("census_tract", "year", F.col(pred_score).alias("score"), F.lit("predicted").alias("data_type"))
    return h.unionByName(p)


def prediction_year_summary(pred: DataFrame, score: str = "predicted_opportunity_score",
                            conf: str | None = "prediction_confidence", high: float = 70) -> DataFrame:
    """per year count, avg, min, max, count >= 70 (and avg confidence)."""
    aggs = [F.count(F.lit(1)).alias("count"), F.avg(score).alias("avg_score"), F.min(score).alias("min_score"),
            F.max(score).alias("max_score"), F.count_if(F.col(score) >= high).alias("high_count")]
    if conf and conf in pred.columns:
        aggs.append(F.avg(conf).alias("avg_confidence"))
    return pred.groupBy("year").agg(*aggs)


def consistent_high_performers(pred: DataFrame, score: str = "predicted_opportunity_score",
                               conf: str = "prediction_confidence", min_avg: float = 70, min_min: float = 56,
                               k: int = 15) -> DataFrame:
    """F16: per tract avg / min / max / confidence; avg >= 70 and min >= 56; top 15."""
    g = pred.groupBy("census_tract").agg(F.avg(score).alias("avg_score"), F.min(score).alias("min_score"),
                                         F.max(score).alias("max_score"), F.avg(conf).alias("avg_confidence"))
    return (g.filter((F.col("avg_score") >= min_avg) & (F.col("min_score") >= min_min))
             .orderBy(F.desc("avg_score"), "census_tract").limit(k))


def top_per_year(pred: DataFrame, score: str = "predicted_opportunity_score", k: int = 10) -> DataFrame:
    """Top k per year by score (ties by tract)."""
    w = Window.partitionBy("year").orderBy(F.desc(score), "census_tract")
    return pred.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def level_pivot(forecasts: DataFrame, level_col: str = "predicted_opportunity_level",
                levels: Sequence[str] = ("High", "Medium", "Low")) -> DataFrame:
    """(years_ahead x level) counts with missing cells 0."""
    return forecasts.groupBy("years_ahead").pivot(level_col, list(levels)).count().na.fill(0)


def forecast_change_extremes(forecasts: DataFrame, score: str = "predicted_opportunity_score",
                             k: int = 5) -> DataFrame:
    """I8: per tract last-horizon minus first-horizon score; top and bottom k."""
    g = forecasts.groupBy("census_tract").agg(
        (F.max_by(score, "years_ahead") - F.min_by(score, "years_ahead")).alias("forecast_change"))
    up = g.orderBy(F.desc("forecast_change"), "census_tract").limit(k).withColumn("direction", F.lit("top"))
    down = g.orderBy("forecast_change", "census_tract").limit(k).withColumn("direction", F.lit("bottom"))
    return up.unionByName(down)


def forecast_level(score: Column) -> Column:
    """K18."""
    return F.when(score >= 75, "High").when(score >= 50, "Medium").otherwise("Low")
