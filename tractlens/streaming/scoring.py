"""Structured Streaming entry points.

The reference is batch only; the row-level jobs (non-strict validation,
application features without global statistics, rule reasons, risk tiers)
are plain column expressions, so the same functions run on a streaming
DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.functions import parse
from tractlens.operators import features as fe
from tractlens.operators import rules as R
from tractlens.operators import validate as v


def application_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files of applications as a stream (schema is required for streams)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def score_applications(df: DataFrame) -> DataFrame:
    """Row-level scoring usable on batch and streaming frames: non-strict HMDA
    sanitizing, financial features, credit proxy, rule-based denial reasons and
    per-factor risk tiers."""
    clean = v.clean_dataframe(df, "hmda")
    feats = fe.financial_features(clean, winsorize_numeric=False)
    feats = fe.credit_score_proxy(feats)
    reasons = R.rule_denial_reasons(F.col("debt_to_income_ratio"), parse.ltv_v1(F.col("loan_to_value_ratio")),
                                    F.col("credit_score") if "credit_score" in df.columns else F.lit(None),
                                    F.col("income") * 1000, F.col("loan_amount"), F.col("property_value"))
    out = feats.withColumn("rule_denial_reasons", reasons)
    return fe.risk_tiers(out.withColumn("loan_to_value_ratio", parse.ltv_v1(F.col("loan_to_value_ratio"))))


def start_scoring(spark: SparkSession, stream: DataFrame, sink_path: str, checkpoint_path: str,
                  name: str = "application_scoring", available_now: bool = True, fmt: str = "parquet"):
    """Start the scoring stream into ``sink_path``; returns the StreamingQuery.

    ``checkpoint_path`` is the stream's own folder on shared storage: a restart with
    the same path goes on after the files that were already scored.
    """
    w = (score_applications(stream).writeStream.format(fmt).option("checkpointLocation", checkpoint_path)
         .outputMode("append").queryName(name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_path) if fmt != "memory" else w.start()
