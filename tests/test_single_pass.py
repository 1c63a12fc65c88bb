"""Frames that several passes read are computed once."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tractlens.operators import denial as dn
from tractlens.operators import features as fe
from tractlens.operators import ml
from tractlens.plans import denial, models
from tractlens.plans.validation import model_input


def counted(spark, df, column):
    """``df`` with a column that goes through Python, and the number of values that did."""
    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    kind = df.schema[column].dataType
    return df.withColumn(column, F.udf(touch, kind)(F.col(column))), seen


def test_winsorized_frame_is_computed_once(spark):
    rows = spark.createDataFrame([(i, float(i), f"t{i % 3}") for i in range(200)], "id long, x double, name string").repartition(2)
    df, seen = counted(spark, rows, "x")
    out = fe.label_encode(fe.winsorize_columns(df, ["x"], 0.1, 0.9), ["name"])
    got = {r["id"]: (r["x"], r["name_encoded"]) for r in out.collect()}
    assert seen.value == 200
    assert got[0] == (pytest.approx(19.9), 0) and got[199] == (pytest.approx(179.1), 1) and got[50] == (50.0, 2)


def test_metrics_read_scores_once(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(float(i % 2), float(i % 3 == 0), Vectors.dense(-i % 5, i % 5)) for i in range(60)]
    df, seen = counted(spark, spark.createDataFrame(rows, ["label", "prediction", "rawPrediction"]), "prediction")
    got = ml.classification_metrics(df).first()
    hits = sum(a == b for a, b, _ in rows)
    assert seen.value == 60 and got["accuracy"] == round(hits / 60, 4)


def test_reason_metrics_read_scores_once(spark):
    rows = [(1 + i % 2, i % 3 % 2, int(i % 4 == 1), i % 7 / 7) for i in range(84)]
    df, seen = counted(spark, spark.createDataFrame(rows, "code int, truth int, predicted int, score double"), "score")
    got = {r["code"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in dn.reason_metrics(df).collect()}
    assert seen.value == 84
    assert got == {c: tuple(sum(r[:3] == (c, t, p) for r in rows) for t, p in ((1, 1), (0, 1), (1, 0), (0, 0))) for c in (1, 2)}


def test_model_rows_are_computed_once(spark, monkeypatch):
    counters = []

    def source(s, sf):
        df, seen = counted(s, model_input(s, sf), "income")
        counters.append((seen, model_input(s, sf).filter("action_taken IN (1, 2, 3, 6, 7, 8)").count()))
        return df

    monkeypatch.setattr(models, "model_input", source)
    d = models.labelled(spark, SF001)
    assert d.agg(F.sum("income")).first()[0] > 0 and d.filter("is_test = 1").agg(F.count("income")).first()[0] > 0
    assert [(s.value, n) for s, n in counters] == [(n, n) for _, n in counters]
    counters.clear()
    monkeypatch.setattr(denial, "model_input", source)
    d = denial._modelled(spark, SF001)
    first = counters[0][0].value
    assert first > 0 and d.agg(F.sum("income")).first()[0] > 0
    assert counters[0][0].value == first
