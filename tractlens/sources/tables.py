"""Driver tables and the lending-shaped views built on them.

The test tables are TPC-H-like (orders, customer, lineitem, supplier, ...).
``applications``, ``census`` and ``hpi`` re-shape them into the loan
application / census tract / house price index tables the operators expect.
Every view is a lazy DataFrame, so filters and column pruning reach the
parquet scans.

Scale notes
-----------
* ``applications`` joins orders to customer on the customer key.  Neither side
  is broadcast by hand: customer grows with the data, so the join is left to
  AQE (sort-merge, or broadcast when AQE measures a small side at run time).
* ``hpi`` pre-aggregates lineitem to one row per order (integer cents and a
  count) before it meets orders, so the big lineitem side shuffles one partial
  row per order instead of every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan out to all cores where its splits are fewer.  A scan that has as many splits as
    cores, in however few files, is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tract_id(nationkey: Column, custkey: Column) -> Column:
    """11-character tract id: '20' + 3-digit county + 6-digit tract."""
    return F.concat(county_id(nationkey), F.lpad((custkey % 8).cast("string"), 6, "0"))


def county_id(nationkey: Column) -> Column:
    return F.concat(F.lit("20"), F.lpad(nationkey.cast("string"), 3, "0"))


#: Bytecodes from which the JVM only interprets a method.
COMPILED_BYTES = "8000"


def compiled_stages(spark: SparkSession) -> None:
    """Stages of long expressions whose one generated method the JVM would only interpret (ten times
    slower and more) run as separate operators instead, where the session has Spark's default."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, COMPILED_BYTES)


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m)


def applications(spark: SparkSession, sf_dir: str, deal_out: bool = False) -> DataFrame:
    """One loan application per order (HMDA-like columns).

    ``deal_out`` spreads a scan of few files; row-level jobs and exact quantiles use it.
    Sums of doubles don't: their last bit depends on the order of rows.
    """
    compiled_stages(spark)
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if deal_out:
        o = spread(o)
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("o_orderkey")
    k20 = _mod(k, 20)
    action = (F.when(k20 < 11, 1).when(k20 == 11, 2).when(k20 < 16, 3).when(k20 == 16, 4)
              .when(k20 == 17, 5).when(k20 == 18, 6).when(_mod(k, 40) == 19, 7).otherwise(8))
    dti = (F.when(_mod(k, 9) == 0, "<20%").when(_mod(k, 9) == 1, "20%-<30%")
           .when(_mod(k, 9) == 2, "30%-<36%").when(_mod(k, 9) == 3, "36")
           .when(_mod(k, 9) == 4, "43").when(_mod(k, 9) == 5, "49")
           .when(_mod(k, 9) == 6, "50%-60%").when(_mod(k, 9) == 7, ">60%").otherwise("Exempt"))
    seg = F.col("c_mktsegment")
    return j.select(
        k.alias("application_id"),
        F.year("o_orderdate").cast("int").alias("activity_year"),
        county_id(F.col("c_nationkey")).alias("county_code"),
        tract_id(F.col("c_nationkey"), F.col("c_custkey")).alias("census_tract"),
        action.cast("int").alias("action_taken"),
        F.col("o_totalprice").alias("loan_amount"),
        F.when(_mod(k, 23) == 0, F.lit(None).cast("double"))
         .otherwise((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(50.0)).alias("income"),
        F.when(_mod(k, 29) == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") * F.lit(100.0) / (F.lit(40) + _mod(k, 70)).cast("double"))
         .alias("property_value"),
        dti.alias("debt_to_income_ratio"),
        F.when(_mod(k, 31) == 0, F.lit("Exempt"))
         .otherwise((F.lit(40) + _mod(k, 70)).cast("string")).alias("loan_to_value_ratio"),
        ((F.lit(30) + _mod(k, 50)).cast("double") / F.lit(10)).alias("interest_rate"),
        F.when(_mod(k, 3) == 0, 180).when(_mod(k, 3) == 1, 240).otherwise(360)
         .cast("int").alias("loan_term"),
        (F.lit(1) + _mod(k, 4)).cast("int").alias("loan_type"),
        F.when(seg == "BUILDING", 1).when(seg == "HOUSEHOLD", 2).when(seg == "FURNITURE", 3)
         .otherwise(31).cast("int").alias("loan_purpose"),
        (F.lit(1) + _mod(k, 2)).cast("int").alias("occupancy_type"),
        (F.lit(1) + F.col("c_nationkey") % 5).cast("int").alias("applicant_race"),
        (F.lit(1) + F.col("c_custkey") % 2).cast("int").alias("applicant_sex"),
        (F.lit(300) + (k * 37) % 551).cast("int").alias("credit_score"),
        F.when(k20.between(12, 15), F.lit(1) + _mod(k, 9)).otherwise(10)
         .cast("int").alias("denial_reason_1"),
        F.when(k20.between(12, 13), F.lit(1) + (k * 7) % 9)
         .cast("int").alias("denial_reason_2"),
    )


def applications_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``applications`` with the demographic, geographic and pricing columns that D10-D12 and
    D14 read, derived from the application id (FIXTURES §3)."""
    a = applications(spark, sf_dir)
    k = F.col("application_id")
    return a.withColumns({
        "applicant_race-1": F.col("applicant_race").cast("string"),
        "co-applicant_sex": F.when(_mod(k, 3) == 0, F.lit("5")).otherwise((_mod(k, 2) + 1).cast("string")),
        "applicant_age": F.when(_mod(k, 11) != 0, (_mod(k, 90) + 18).cast("int")),
        "tract_to_msa_income_percentage": F.when(_mod(k, 17) != 0, (_mod(k, 90) + 60).cast("double")).otherwise(F.lit(0.0)),
        "tract_minority_population_percent": _mod(k, 101).cast("double"),
        "rate_spread": F.when(_mod(k, 7) != 0, (_mod(k, 80) - 10) / F.lit(10.0)),
    })


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One demographic row per tract, aggregated from customer."""
    from tractlens.functions.stats import grouped_agg_with_medians

    c = read_table(spark, sf_dir, "customer").select(
        tract_id(F.col("c_nationkey"), F.col("c_custkey")).alias("census_tract"),
        F.col("c_acctbal"))
    agg = grouped_agg_with_medians(
        c, ["census_tract"],
        [F.count(F.lit(1)).alias("_n"),
         F.sum(F.when(F.col("c_acctbal") < 0, 100).otherwise(5)).alias("_unemp")],
        {"_med_bal": F.col("c_acctbal")})
    return agg.select(
        "census_tract",
        (F.col("_n") * 400).cast("bigint").alias("total_population"),
        (F.col("_n") * 220).cast("bigint").alias("civilian_labor_force"),
        F.col("_unemp").cast("bigint").alias("unemployed"),
        (F.lit(30000.0) + F.lit(8.0) * F.col("_med_bal")).alias("median_household_income"),
    )


def hpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House price index per tract and year: mean unit price of the order lines.

    Unit prices are summed as integer cents (exact in any summation order), so
    the mean is the same double on every engine and every partitioning; it is
    reported to 4 decimals.
    """
    cents = F.round(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")) * 100).cast("bigint")
    li = (read_table(spark, sf_dir, "lineitem")
          .select("l_orderkey", cents.alias("c"))
          .groupBy("l_orderkey")
          .agg(F.sum("c").alias("sc"), F.count("c").alias("nc")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
           .join(c, o.o_custkey == c.c_custkey, "inner"))
    g = (j.groupBy(tract_id(F.col("c_nationkey"), F.col("c_custkey")).alias("census_tract"),
                   F.year("o_orderdate").cast("int").alias("year"))
          .agg(F.sum("sc").alias("_s"), F.sum("nc").alias("_n")))
    mean = F.col("_s") / F.col("_n") / 100
    return g.select("census_tract", "year", (F.floor(mean * 10000 + 0.5) / 10000).alias("hpi"))


def lenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lender per application: the lowest supplier key on the order, named by supplier."""
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.min("l_suppkey").alias("lender_key")))
    s = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("lender_key"), F.col("s_name").alias("lender_name"))
    return (li.join(s, "lender_key", "inner")
              .select(F.col("l_orderkey").alias("application_id"), "lender_key", "lender_name"))


# Column order of ``applications`` (used by oracle SQL generators).
APPLICATION_COLUMNS = [
    "application_id", "activity_year", "county_code", "census_tract", "action_taken", "loan_amount",
    "income", "property_value", "debt_to_income_ratio", "loan_to_value_ratio", "interest_rate",
    "loan_term", "loan_type", "loan_purpose", "occupancy_type", "applicant_race", "applicant_sex",
    "credit_score", "denial_reason_1", "denial_reason_2"]
