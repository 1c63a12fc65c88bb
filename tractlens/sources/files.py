"""File sources.

Reads always use an explicit schema where the layout is known (no
``inferSchema`` pass over the data).  Per-year files become one DataFrame with
a ``year`` column; once written with ``partitionBy('activity_year')`` a year
filter prunes partitions instead of files being chosen by hand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.functions import parse

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: census API variable codes.
CENSUS_VARIABLES = {
    "B01003_001E": "total_population",
    "B19013_001E": "median_household_income",
    "B01002_001E": "median_age",
    "B23025_003E": "civilian_labor_force",
    "B23025_005E": "unemployed",
    "B25003_002E": "owner_occupied",
    "B25003_003E": "renter_occupied",
}
CENSUS_SENTINEL = -666666666
MIN_HMDA_ROWS, MIN_CENSUS_ROWS = 1000, 10
# ---------------------------------------------------------------------------

HMDA_TEXT_SCHEMA = T.StructType([
    T.StructField("activity_year", T.IntegerType()), T.StructField("state_code", T.StringType()),
    T.StructField("county_code", T.StringType()), T.StructField("census_tract", T.StringType()),
    T.StructField("action_taken", T.IntegerType()), T.StructField("loan_amount", T.DoubleType()),
    T.StructField("income", T.DoubleType()), T.StructField("property_value", T.StringType()),
    T.StructField("debt_to_income_ratio", T.StringType()), T.StructField("loan_to_value_ratio", T.StringType()),
    T.StructField("interest_rate", T.StringType()), T.StructField("loan_term", T.StringType()),
    T.StructField("loan_type", T.IntegerType()), T.StructField("loan_purpose", T.IntegerType()),
    T.StructField("occupancy_type", T.IntegerType()),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on the cluster file system (driver metadata call)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A1: header CSV with an explicit schema (text where the column is ambiguous)."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema is not None else r).csv(path)


def read_yearly(spark: SparkSession, files: Mapping[int, str], schema: T.StructType | None = None,
                fmt: str = "csv") -> DataFrame | None:
    """A2 + J1: one read per existing file with a literal year, union by name
    (missing columns allowed); missing files are skipped."""
    out = None
    for year, path in sorted(files.items()):
        if not path_exists(spark, path):
            continue
        df = read_csv(spark, path, schema) if fmt == "csv" else spark.read.format(fmt).load(path)
        if "activity_year" not in df.columns:
            df = df.withColumn("activity_year", F.lit(int(year)))
        df = df.withColumn("year", F.lit(int(year)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def split_by_year(df: DataFrame, years: Sequence[int], col: str = "activity_year") -> DataFrame:
    """A3: the training years of one combined scan (pushed down / partition-pruned)."""
    return df.filter(F.col(col).isin([int(y) for y in years]))


def state_rows(df: DataFrame, state: str | int, col: str = "state_code") -> DataFrame:
    """Rows of one state, by its number (leading zeros don't matter) or its letters; the filter
    is on the bare column, so that it reaches the scan, where the column is text."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        text = str(state)
        forms = {text, text.lstrip("0"), text.zfill(2)} if text.isdigit() else {text}
        return df.filter(c.isin(*sorted(forms)))
    return df.filter(c == int(state))


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """A4: first candidate path that exists."""
    for p in candidates:
        if path_exists(spark, p):
            return p
    return None


def combine_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """A5: keep the columns all frames share (in the first frame's order),
    union them and drop exact duplicate rows."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    out = frames[0].select(*common)
    for f in frames[1:]:
        out = out.unionByName(f.select(*common))
    return out.dropDuplicates()


def census_api_json(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """A6 + C12: census API output (a JSON array of string arrays, first row =
    variable codes) to one row per tract.  Each file is parsed by the task that
    reads it; the header row is matched to variable names, values are
    ``try_cast`` and the -666666666 'no data' sentinel becomes null (trap T14)."""
    raw = spark.read.text(path, wholetext=True)
    arr = raw.select(F.from_json("value", T.ArrayType(T.ArrayType(T.StringType()))).alias("a"))
    rows = arr.select(F.col("a")[0].alias("hdr"), F.posexplode("a").alias("pos", "r")).filter(F.col("pos") > 0)

    def field(name: str):
        # get() returns null for a variable the file does not carry (position 0).
        return F.get(F.col("r"), F.array_position(F.col("hdr"), F.lit(name)).cast("int") - 1)

    def num(name: str):
        v = field(name).try_cast("double")
        return F.when(v == CENSUS_SENTINEL, F.lit(None).cast("double")).otherwise(v)

    cols = [num(code).alias(name) for code, name in CENSUS_VARIABLES.items()]
    out = rows.select(field("state").alias("state_code"), field("county").alias("county_code"),
                      field("tract").alias("tract_code"), *cols)
    out = out.withColumn("census_tract", F.concat(F.lpad("state_code", 2, "0"), F.lpad("county_code", 3, "0"),
                                                  F.lpad("tract_code", 6, "0")))
    out = out.withColumn("unemployment_rate", parse.unemployment_rate(F.col("unemployed"), F.col("civilian_labor_force")))
    out = out.withColumn("homeownership_rate", parse.ownership_rate(F.col("owner_occupied"), F.col("renter_occupied")))
    if year is not None:
        out = out.withColumn("year", F.lit(int(year)))
    return out


def projected(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Column-pruned (and optionally row-limited) scan."""
    out = df.select(*columns)
    return out.limit(limit) if limit is not None else out


def source_check(hmda: DataFrame, census: DataFrame, hpi: DataFrame | None = None) -> DataFrame:
    """Row counts and warnings as a check table (one aggregate per source)."""
    h = hmda.agg(F.count(F.lit(1)).alias("n")).select(F.lit("hmda").alias("source"), "n",
                                                       F.lit(MIN_HMDA_ROWS).alias("min_rows"), F.lit(True).alias("required"))
    c = census.agg(F.count(F.lit(1)).alias("n")).select(F.lit("census").alias("source"), "n",
                                                         F.lit(MIN_CENSUS_ROWS).alias("min_rows"), F.lit(True).alias("required"))
    out = h.unionByName(c)
    if hpi is not None:
        out = out.unionByName(hpi.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("hpi").alias("source"), "n", F.lit(0).alias("min_rows"), F.lit(False).alias("required")))
    return out.withColumn("status", F.when(F.col("n") < F.col("min_rows"), "warning").otherwise("ok"))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read back JSON lines written by the sinks (records keep their year)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)
