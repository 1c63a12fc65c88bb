"""Source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tractlens.oracle.views import APPLICATIONS, CENSUS, HPI, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.plans.temporal import YEARLY_DOUBLES, YEARLY_SQL, yearly
from tractlens.session import ensure_checkpoint_dir
from tractlens.sources import files, nested
from tractlens.sources.tables import applications, census, hpi


@register("a3_split_by_year", with_ctes(APPLICATIONS, body="""
SELECT activity_year, count(*) AS applications FROM applications GROUP BY 1"""))
def a3(spark, sf):
    a = applications(spark, sf)
    years = [r[0] for r in a.select("activity_year").distinct().collect()]
    return files.split_by_year(a, years).groupBy("activity_year").agg(F.count(F.lit(1)).alias("applications"))


@register("a5_combine_yearly", with_ctes(APPLICATIONS, body="""
SELECT count(*) AS rows, count(DISTINCT activity_year) AS years FROM (
  SELECT DISTINCT application_id, activity_year, census_tract, action_taken, loan_amount FROM applications)"""))
def a5(spark, sf):
    a = applications(spark, sf)
    years = [r[0] for r in a.select("activity_year").distinct().collect()]
    # One frame per year, as separate yearly files would give; the first frame
    # carries an extra column that the others lack, and one year is repeated.
    frames = [a.filter(F.col("activity_year") == y).select(
        "application_id", "activity_year", "census_tract", "action_taken", "loan_amount",
        *(["income"] if i == 0 else [])) for i, y in enumerate(sorted(years))]
    combined = files.combine_frames(frames + frames[-1:])
    return combined.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("activity_year").alias("years"))


@register("a8_source_check", with_ctes(APPLICATIONS, CENSUS, HPI, body="""
SELECT 'hmda' AS source, count(*) AS n, 1000 AS min_rows, TRUE AS required,
       CASE WHEN count(*) < 1000 THEN 'warning' ELSE 'ok' END AS status FROM applications
UNION ALL SELECT 'census', count(*), 10, TRUE, CASE WHEN count(*) < 10 THEN 'warning' ELSE 'ok' END FROM census
UNION ALL SELECT 'hpi', count(*), 0, FALSE, 'ok' FROM hpi"""))
def a8(spark, sf):
    return files.source_check(applications(spark, sf), census(spark, sf), hpi(spark, sf))


# Written to the shared folder and read back --------------------------
@register("a10_a11_nested_results", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, body="SELECT * FROM yearly"), YEARLY_DOUBLES))
def a10(spark, sf):
    y = yearly(spark, sf).drop("_raw_score")
    path = _scratch(spark, "nested")
    nested.write_nested(y, path, block_rows=100)
    return finalize(nested.read_nested(spark, path, y.schema))


@register("i10_sorted_sink", rounded(with_ctes(APPLICATIONS, YEARLY_SQL, body="""
SELECT *, TRUE AS in_order FROM yearly WHERE census_tract >= '20010'"""), YEARLY_DOUBLES))
def i10(spark, sf):
    """The tracts from a point on, by a pruned read; ``in_order`` says that their file holds no row
    before one of the file before it."""
    y = yearly(spark, sf).drop("_raw_score")
    path = _scratch(spark, "sorted")
    nested.write_sorted(y, path, file_rows=200)
    back = spark.read.parquet(path).withColumn("_file", F.input_file_name())
    key = F.struct("census_tract", "year")
    ends = back.groupBy("_file").agg(F.min(key).alias("a"), F.max(key).alias("z"))  # a row for each file
    before = F.lag("z").over(Window.orderBy("_file"))
    ordered = ends.select("_file", F.coalesce(before < F.col("a"), F.lit(True)).alias("in_order"))
    return finalize(back.filter("census_tract >= '20010'").join(F.broadcast(ordered), "_file").drop("_file"))


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("c1_state_filter", with_ctes(APPLICATIONS, CENSUS, HPI, body="""
SELECT 'census' AS source, census_tract AS key FROM census WHERE left(census_tract, 2) = '20'
UNION ALL SELECT 'applications', CAST(application_id AS VARCHAR) FROM applications WHERE left(census_tract, 2) = '20' AND county_code = '20007'"""))
def c1(spark, sf):
    kansas = files.state_rows(census(spark, sf).withColumn("state_code", F.substring("census_tract", 1, 2)), "20")
    a = files.state_rows(applications(spark, sf).withColumn("state_abbr", F.lit("KS")), "KS", "state_abbr")
    return kansas.select(F.lit("census").alias("source"), F.col("census_tract").alias("key")).unionByName(
        a.filter("county_code = '20007'").select(F.lit("applications").alias("source"), F.col("application_id").cast("string").alias("key")))
