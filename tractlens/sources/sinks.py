"""Sinks.

Writers never overwrite one of their own inputs (trap T9) and never gather a
whole table into one task: record sinks are written by the executors,
partitioned by year, and only small summary tables go through a single file.
"""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _norm(p: str) -> str:
    return urlparse(p).path.rstrip("/") or p.rstrip("/")


def _input_paths(df: DataFrame) -> set[str]:
    try:
        return {_norm(p) for p in df.inputFiles()}
    except Exception:  # noqa: BLE001 - not file based
        return set()


def _guard(df: DataFrame, path: str) -> None:
    target = _norm(path)
    for p in _input_paths(df):
        if p == target or p.startswith(target + "/"):
            raise ValueError(f"refusing to overwrite an input of this DataFrame: {path}")


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite, header, no index."""
    _guard(df, path)
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines; nested struct / array columns keep their shape."""
    _guard(df, path)
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def forecast_year_summary(pred: DataFrame, score: str = "predicted_opportunity_score", high: float = 70) -> DataFrame:
    """A10 summary: per year count, avg, min, max and the count at or above 70."""
    return pred.groupBy("year").agg(F.count(F.lit(1)).alias("count"), F.avg(score).alias("avg"),
                                    F.min(score).alias("min"), F.max(score).alias("max"),
                                    F.count_if(F.col(score) >= high).alias("high_count"))


def save_forecast_results(pred: DataFrame, out_dir: str) -> None:
    """A10: ``summary`` (one row per year) and ``records`` (every prediction,
    written in parallel and partitioned by year, with ``generated_at``)."""
    write_json(forecast_year_summary(pred), os.path.join(out_dir, "summary"))
    write_json(pred.withColumn("generated_at", F.current_timestamp()), os.path.join(out_dir, "records"),
               partition_by="year")


def save_model(model, path: str) -> None:
    """MLlib persistence (pipeline + fitted stages)."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def validation_report_markdown(report: DataFrame, title: str = "Data Validation Report") -> str:
    """Small driver-side formatter over the (bounded, one row per rule
    issue) report table."""
    rows = report.orderBy("data_type", "check", "column").collect()
    lines = [f"# {title}", ""]
    for dt in sorted({r["data_type"] for r in rows}):
        lines.append(f"## {dt}")
        for r in rows:
            if r["data_type"] != dt:
                continue
            prefix = {"error": "❌", "warning": "⚠️"}.get(r["severity"], "•")
            lines.append(f"- {prefix} {r['message']}")
        lines.append("")
    return "\n".join(lines)


def write_text(path: str, text: str) -> None:
    """Small report files (markdown / JSON summaries) written by the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def training_report(metrics: DataFrame, data_summary: dict) -> str:
    """JSON text of data, feature and metric summaries (metrics is a few rows)."""
    return json.dumps({"data": data_summary, "metrics": [r.asDict() for r in metrics.collect()]}, indent=2,
                      default=str)
