"""Nested result files and sorted files.

A result file keeps the records of a year as one nested array.  At scale no row can hold a
year, so a file is many JSON lines of the same shape, each with the records of one block of a
year: ``{"data_by_year": {"1999": [{...}, ...]}}``.  Blocks are sized from the year's counted rows and
their rows dealt out by a hash, so that a block holds about ``block_rows`` rows; reading them back is ``from_json`` under the records' schema and two explodes, all on the executors.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.sources.sinks import _guard, write_csv, write_json

#: Records of one nested array, and rows of one sorted file.
BLOCK_ROWS, FILE_ROWS = 10_000, 1_000_000
#: Fixed value that must equal the reference: a high score.
HIGH_SCORE = 70


def write_nested(df: DataFrame, path: str, year: str = "year", order: Sequence[str] = ("census_tract",), block_rows: int = BLOCK_ROWS) -> None:
    """A10: every row as a record in an array of its year; records keep all other columns.
    Rows of a null year stand under the key ``null``."""
    _guard(df, path)
    y = F.coalesce(F.col(f"`{year}`").cast("string"), F.lit("null"))
    sizes = df.groupBy(y.alias("_y")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))  # a row for each year
    record = F.struct(*[F.col(f"`{c}`") for c in [*order, *[c for c in df.columns if c not in {*order, year}]]])
    rows = df.select(y.alias("_y"), record.alias("_r"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_h"))
    blocks = rows.join(F.broadcast(sizes), "_y").groupBy("_y", F.pmod("_h", F.col("_blocks")).alias("_b")).agg(
        F.sort_array(F.collect_list("_r")).alias("_rs"))
    blocks.select(F.create_map("_y", "_rs").alias("data_by_year")).write.mode("overwrite").json(path)


def read_nested(spark: SparkSession, path: str, schema: T.StructType, year: str = "year") -> DataFrame:
    """The records back as rows of ``schema`` (which has the year's column)."""
    record = T.StructType([f for f in schema.fields if f.name != year])
    line = T.StructType([T.StructField("data_by_year", T.MapType(T.StringType(), T.ArrayType(record)))])
    parsed = spark.read.text(path).select(F.from_json("value", line, {"mode": "FAILFAST"}).alias("j"))
    rows = parsed.select(F.explode("j.data_by_year").alias("_y", "_rs")).select("_y", F.explode("_rs").alias("_r"))
    kind = schema[year].dataType
    return rows.select(*[F.when(F.col("_y") != "null", F.col("_y")).cast(kind).alias(year) if f.name == year
                         else F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields])


def year_summary(df: DataFrame, score: str, high: float | None = None) -> DataFrame:
    """A10: tracts, mean and range of a score for each year; with ``high``, how many reach it."""
    aggs = [F.count(F.lit(1)).alias("census_tracts"), F.avg(score).alias("average_score"),
            F.array(F.min(score), F.max(score)).alias("score_range")]
    if high is not None:
        aggs.append(F.count_if(F.col(score) >= high).alias("high_opportunity_tracts"))
    return df.groupBy("year").agg(*aggs)


def performance(metrics: DataFrame) -> DataFrame:
    """A10: a row for each training year of ``(year, model, r2, mse, mae)``: the best model by R2
    (ties by name), its scores, and all models' scores as a map."""
    best = F.min_by(F.struct("model", "r2", "mse", "mae"), F.struct(-F.col("r2"), F.col("model")))
    details = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct("r2", "mse", "mae").alias("scores")))))
    return metrics.groupBy("year").agg(best.alias("_b"), details.alias("model_details")).select(
        "year", F.col("_b.model").alias("best_model"), F.col("_b.r2").alias("r2_score"), F.col("_b.mse").alias("mse"),
        F.col("_b.mae").alias("mae"), "model_details")


def save_results(out_dir: str, scores: DataFrame, predictions: DataFrame, metrics: DataFrame, feature_count: int) -> None:
    """A10: the four result files: ``results`` (counts), ``historical`` and ``predictions``
    (nested records beside a summary for each year), and ``performance``."""
    at = lambda *parts: os.path.join(out_dir, *parts)
    write_nested(scores, at("historical", "data"))
    write_json(year_summary(scores, "opportunity_score"), at("historical", "summary"))
    write_nested(predictions, at("predictions", "data"))
    write_json(year_summary(predictions, "predicted_opportunity_score", HIGH_SCORE), at("predictions", "summary"))
    write_json(performance(metrics).withColumn("feature_count", F.lit(feature_count)), at("performance"))
    counts = scores.agg(F.count_distinct("year").alias("yearly_data_loaded"), F.count(F.lit(1)).alias("_s")).crossJoin(
        predictions.agg(F.count_distinct("year").alias("predictions_generated"), F.count(F.lit(1)).alias("_p"))).crossJoin(
        metrics.agg(F.count_distinct("year").alias("models_trained")))
    write_json(counts.select("yearly_data_loaded", "models_trained", "predictions_generated", (F.col("_s") + F.col("_p")).alias("timeline_records"),
                             F.current_timestamp().alias("timestamp")), at("results"))


def export_yoy(metrics: DataFrame, out_dir: str) -> None:
    """The full analysis as nested JSON, and the segment summary as CSV."""
    from tractlens.operators.dashboard import yoy_export

    write_nested(metrics, os.path.join(out_dir, "analysis"))
    write_csv(yoy_export(metrics), os.path.join(out_dir, "segments"))


def write_sorted(df: DataFrame, path: str, by: Sequence[str] = ("census_tract", "year"), fmt: str = "parquet", file_rows: int = FILE_ROWS) -> None:
    """Files that follow each other in the order of ``by`` and are sorted inside, so that a
    reader's filter on it skips files and row groups by their statistics."""
    _guard(df, path)
    files = max(1, -(-df.count() // file_rows))
    keys = [F.col(f"`{c}`") for c in by]
    w = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
