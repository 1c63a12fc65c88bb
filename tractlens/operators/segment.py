"""Market segmentation.

Segment profiles are one ``groupBy(segment)`` aggregate over the tract table
(bounded by the number of tracts); the per-segment rules (risk level, return
potential, priority, products, channels, pricing, competition) are column
expressions on that small result.  K-means uses MLlib; the only driver loop is
over candidate k values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlens.functions.frames import pooled, training_frame
from tractlens.functions.stats import grouped_agg_with_medians

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
CLUSTER_FEATURES = ["total_population", "median_household_income", "unemployment_rate", "loan_count",
                    "avg_loan_amount", "approval_rate", "denial_rate", "opportunity_score"]
SEGMENT_NAMES = ["Prime Urban Markets", "Emerging Suburban Areas", "High-Risk Rural Communities",
                 "Stable Middle Markets", "Low-Activity Zones", "Premium Opportunity Areas"]
DEMO_FEATURES = ["total_population", "median_household_income", "unemployment_rate", "civilian_labor_force"]
LENDING_FEATURES = ["loan_count", "avg_loan_amount", "approval_rate", "denial_rate"]
OPPORTUNITY_FEATURES = ["opportunity_score", "market_accessibility", "risk_factors", "economic_indicators",
                        "lending_activity"]
PRIORITY = {("Low", "High"): "High Priority", ("Low", "Moderate"): "High Priority",
            ("Moderate", "High"): "Medium Priority", ("Moderate", "Moderate"): "Medium Priority",
            ("High", "High"): "Medium Priority", ("Low", "Low"): "Low Priority",
            ("Moderate", "Low"): "Low Priority", ("High", "Moderate"): "Low Priority", ("High", "Low"): "Avoid"}
PRIORITY_DEFAULT = "Medium Priority"
PRODUCTS_BY_INCOME = [(80000, ["Jumbo Loans", "Premium Mortgage Products", "Investment Property Loans"]),
                      (50000, ["Conventional Loans", "FHA Loans", "Refinancing Products"])]
PRODUCTS_LOW_INCOME = ["FHA Loans", "VA Loans", "First-Time Buyer Programs"]
PRODUCTS_BY_RISK = {"Low": ["Prime Rate Loans", "Quick Approval Products"],
                    "Moderate": ["Standard Products", "Credit Enhancement Programs"]}
PRODUCTS_HIGH_RISK = ["Assisted Purchase Programs", "Credit Counseling Services"]
CHANNELS_HIGH_INCOME = ["Digital Marketing", "Professional Networks", "Direct Mail"]
CHANNELS_OTHER = ["Community Outreach", "Local Partnerships", "Social Media"]
# ---------------------------------------------------------------------------


def kmeans_segments(df: DataFrame, features: Sequence[str] = CLUSTER_FEATURES, k_values: Sequence[int] = range(2, 7),
                    seed: int = 42, id_col: str = "census_tract", starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """L2 + L3: standardise, fit K-means for each k (the cheapest of ``starts``
    starts), keep the best silhouette, and renumber clusters by their centre's first feature so ids and names are
    stable across runs (trap T19).  Returns (segmented rows, k search table)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    present = [c for c in features if c in df.columns]
    base = df.na.fill(0, subset=present)
    prep = Pipeline(stages=[VectorAssembler(inputCols=present, outputCol="_raw", handleInvalid="keep"),
                            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)])
    base = training_frame(base)
    scaled = prep.fit(base).transform(base).persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    results = []
    best = None
    for k in k_values:
        tries = pooled([lambda k=k, i=i: KMeans(k=k, seed=seed + i, featuresCol="features", maxIter=50).fit(scaled) for i in range(starts)])
        model = min(tries, key=lambda m: m.summary.trainingCost)
        pred = model.transform(scaled)
        sil = evaluator.evaluate(pred)
        results.append((int(k), float(sil), float(model.summary.trainingCost)))
        if best is None or sil > best[1]:
            best = (k, sil, model)
    spark = df.sparkSession
    search = spark.createDataFrame(results, "k int, silhouette double, training_cost double")
    k, _, model = best
    centres = model.clusterCenters()
    order = sorted(range(k), key=lambda i: (float(centres[i][0]), i))
    remap = {old: new for new, old in enumerate(order)}
    mapping = F.create_map(*[x for old, new in remap.items() for x in (F.lit(old), F.lit(new))])
    names = F.create_map(*[x for i in range(k) for x in (F.lit(i), F.lit(segment_name(i)))])
    out = (model.transform(scaled)
                .withColumn("market_segment", mapping[F.col("prediction")])
                .withColumn("segment_name", names[F.col("market_segment")])
                .drop("_raw", "features", "prediction"))
    return out, search


def segment_name(i: int) -> str:
    return SEGMENT_NAMES[i] if i < len(SEGMENT_NAMES) else f"Segment {i}"


def risk_level(avg_unemp: Column, avg_denial: Column, avg_income: Column) -> Column:
    """K5 risk: count triggered indicators; >= 2 High, 1 Moderate."""
    n = ((F.coalesce(avg_unemp > 5, F.lit(False))).cast("int")
         + (F.coalesce(avg_denial > 0.15, F.lit(False))).cast("int")
         + (F.coalesce(avg_income < 60000, F.lit(False))).cast("int"))
    return F.when(n >= 2, "High").when(n == 1, "Moderate").otherwise("Low")


def return_potential(avg_pop: Column, avg_loans: Column, avg_income: Column, avg_score: Column) -> Column:
    """K5 return: >= 3 High, >= 2 Moderate."""
    n = ((F.coalesce(avg_pop > 3000, F.lit(False))).cast("int")
         + (F.coalesce(avg_loans > 20, F.lit(False))).cast("int")
         + (F.coalesce(avg_income > 70000, F.lit(False))).cast("int")
         + (F.coalesce(avg_score > 70, F.lit(False))).cast("int"))
    return F.when(n >= 3, "High").when(n >= 2, "Moderate").otherwise("Low")


def strategic_priority(risk: Column, ret: Column) -> Column:
    """K6: 3 x 3 lookup."""
    out = None
    for (r, p), v in PRIORITY.items():
        cond = (risk == r) & (ret == p)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(PRIORITY_DEFAULT)


def segment_profiles(df: DataFrame, segment_col: str = "market_segment") -> DataFrame:
    """F10 + K5 + K6: count, share, mean / median demographics, means of the
    lending and opportunity columns, risk level, return potential and priority."""
    demo = [c for c in DEMO_FEATURES if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("tract_count")]
    aggs += [F.avg(F.col(c)).alias(f"avg_{c}") for c in demo]
    aggs += [F.avg(F.col(c)).alias(f"avg_{c}") for c in LENDING_FEATURES + OPPORTUNITY_FEATURES
             if c in df.columns and c not in demo]
    g = grouped_agg_with_medians(df, [segment_col], aggs, {f"median_{c}": F.col(c) for c in demo})
    total = Window.partitionBy(F.lit(1))  # over the per-segment rows only (few rows)
    g = g.withColumn("percentage_of_market", F.col("tract_count") / F.sum("tract_count").over(total) * 100)

    def a(c):
        return F.col(f"avg_{c}") if f"avg_{c}" in g.columns else F.lit(None).cast("double")
    g = g.withColumn("risk_level", risk_level(a("unemployment_rate"), a("denial_rate"), a("median_household_income")))
    g = g.withColumn("return_potential", return_potential(a("total_population"), a("loan_count"),
                                                          a("median_household_income"), a("opportunity_score")))
    return g.withColumn("strategic_priority", strategic_priority(F.col("risk_level"), F.col("return_potential")))


def product_recommendations(profiles: DataFrame) -> DataFrame:
    """K7 + K8: products (first 3 primary, rest secondary), channels (first 3), pricing."""
    inc = F.col("avg_median_household_income")
    by_income = F.when(inc > PRODUCTS_BY_INCOME[0][0], F.array(*[F.lit(x) for x in PRODUCTS_BY_INCOME[0][1]])) \
                 .when(inc > PRODUCTS_BY_INCOME[1][0], F.array(*[F.lit(x) for x in PRODUCTS_BY_INCOME[1][1]])) \
                 .otherwise(F.array(*[F.lit(x) for x in PRODUCTS_LOW_INCOME]))
    rl = F.col("risk_level")
    by_risk = F.when(rl == "Low", F.array(*[F.lit(x) for x in PRODUCTS_BY_RISK["Low"]])) \
               .when(rl == "Moderate", F.array(*[F.lit(x) for x in PRODUCTS_BY_RISK["Moderate"]])) \
               .otherwise(F.array(*[F.lit(x) for x in PRODUCTS_HIGH_RISK]))
    reach = F.when(F.col("tract_count") > 5, F.array(F.lit("Branch/Office Expansion"))) \
             .otherwise(F.array(F.lit("Digital/Mobile Services")))
    products = F.concat(by_income, by_risk, reach)
    channels = F.concat(
        F.when(inc > 70000, F.array(*[F.lit(x) for x in CHANNELS_HIGH_INCOME]))
         .otherwise(F.array(*[F.lit(x) for x in CHANNELS_OTHER])),
        F.when(F.col("avg_total_population") > 2000, F.array(F.lit("Local Advertising")))
         .otherwise(F.array(F.lit("Referral Programs"))))
    appr = F.coalesce(F.col("avg_approval_rate"), F.lit(0.0))
    pricing = (F.when((rl == "Low") & (appr > 0.8), "Competitive Pricing")
                .when(rl == "Moderate", "Standard Pricing").otherwise("Risk-Adjusted Pricing"))
    return profiles.select(
        F.col(profiles.columns[0]).alias("segment"),
        F.slice(products, 1, 3).alias("primary_products"),
        F.slice(products, 4, 100).alias("secondary_products"),
        F.slice(channels, 1, 3).alias("marketing_channels"), pricing.alias("pricing_strategy"))


def risk_return_matrix(profiles: DataFrame) -> DataFrame:
    """risk = min(unemployment x 10, 50) + denial x 100, capped 100; return = avg score."""
    unemp = F.coalesce(F.least(F.col("avg_unemployment_rate") * 10, F.lit(50.0)), F.lit(0.0)) \
        if "avg_unemployment_rate" in profiles.columns else F.lit(0.0)
    den = F.coalesce(F.col("avg_denial_rate") * 100, F.lit(0.0)) if "avg_denial_rate" in profiles.columns else F.lit(0.0)
    ret = F.coalesce(F.col("avg_opportunity_score"), F.lit(50.0)) if "avg_opportunity_score" in profiles.columns \
        else F.lit(50.0)
    return profiles.select(F.col(profiles.columns[0]).alias("segment"),
                           F.least(unemp + den, F.lit(100.0)).alias("risk_score"), ret.alias("return_score"),
                           "tract_count", "strategic_priority")


def competitive_analysis(df: DataFrame, profiles: DataFrame, segment_col: str = "market_segment") -> DataFrame:
    """F11 + K9: loan and value shares, competitive intensity, attractiveness, strategy."""
    seg = df.groupBy(segment_col).agg(F.sum("loan_count").alias("seg_loans"),
                                      F.sum("avg_loan_amount").alias("seg_value"),
                                      F.avg("approval_rate").alias("seg_approval"))
    tot = Window.partitionBy(F.lit(1))
    seg = seg.withColumn("_tl", F.sum("seg_loans").over(tot)).withColumn("_tv", F.sum("seg_value").over(tot))
    j = seg.join(profiles.select(segment_col, "tract_count", "risk_level", "return_potential", "strategic_priority"),
                 segment_col)
    pts = (F.when(F.col("tract_count") > 5, 2).when(F.col("tract_count") > 2, 1).otherwise(0)
           + F.when(F.col("return_potential") == "High", 3).when(F.col("return_potential") == "Moderate", 2).otherwise(1)
           + F.when(F.col("risk_level") == "Low", 2).when(F.col("risk_level") == "Moderate", 1).otherwise(0))
    pr, rl = F.col("strategic_priority"), F.col("risk_level")
    return j.select(
        segment_col,
        F.when(F.col("_tl") > 0, F.col("seg_loans") / F.col("_tl") * 100).otherwise(F.lit(0.0)).alias("market_share_potential"),
        F.when(F.col("_tv") > 0, F.col("seg_value") / F.col("_tv") * 100).otherwise(F.lit(0.0)).alias("value_share_potential"),
        F.when(F.col("seg_approval") > 0.8, "High").when(F.col("seg_approval") > 0.6, "Moderate").otherwise("Low")
         .alias("competitive_intensity"),
        F.when(pts >= 6, "High").when(pts >= 4, "Moderate").otherwise("Low").alias("market_attractiveness"),
        F.when(pr == "High Priority", "Aggressive Market Entry")
         .when((pr == "Medium Priority") & (rl == "Low"), "Selective Market Entry")
         .when(pr == "Medium Priority", "Partnership Strategy")
         .when(pr == "Low Priority", "Monitor and Evaluate").otherwise("Avoid Market").alias("recommended_strategy"))


def segment_overview(df: DataFrame, segment_col: str = "business_segment", score: str = "opportunity_score",
                     high: float = 70) -> DataFrame:
    """distinct segments, the largest segment and its size, segments holding a score >= 70."""
    sizes = df.groupBy(segment_col).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("mx"))
    return sizes.agg(F.count(F.lit(1)).alias("segment_count"),
                     F.min_by(segment_col, F.struct(-F.col("n"), F.col(segment_col))).alias("largest_segment"),
                     F.max("n").alias("largest_segment_size"),
                     F.count_if(F.col("mx") >= high).alias("segments_with_high_score"))
