"""Forests over large training frames against brute force and MLlib's own."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tractlens.operators import forest as fo
from tractlens.operators import ml
from tractlens.operators import tuning as tn


def frame(spark, n=6000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(4), rng.random()
        rows.append((i, float(x) if i % 13 else None, y, rng.gauss(0, 1), float(rng.random() < 0.1 + 0.2 * x * y)))
    return spark.createDataFrame(rows, "id int, x double, y double, z double, label double").repartition(3).cache()


def test_a_level_counts_and_splits_like_brute_force(spark):
    df = frame(spark, 5000)
    data = fo.binned(df, ["x", "y", "z"], F.col("label"))
    assert [len(c) for c in data.cuts] == [3, 31, 31] and data.cuts[0].tolist() == [0.5, 1.5, 2.5]
    w = np.array([0.7, 2.0])
    tree = fo.grow(data, 0, w, fo.Forest(2, 2, 40, 7))[1]
    rows, seen = [], 0
    for r in data.pieces.collect():
        bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, 3)
        seen += len(bins)
        times = fo._bootstrap([(r["key"], len(bins))], 1, 7)
        rows += [(b, int(y), int(k)) for b, y, k in zip(bins, np.frombuffer(r["labels"], np.uint16), times)]
    assert seen == 5000 and abs(sum(k for *_, k in rows) / seen - 1) < 0.05

    def gini(n):
        n = np.array(n) * w
        return 1 - ((n / n.sum()) ** 2).sum()

    def sizes(some):
        return [sum(k for _, y, k in some if y == c) for c in (0, 1)]

    def gain(some, f, b):
        sides = [[r for r in some if (r[0][f] <= b) == left] for left in (True, False)]
        if min(sum(k for *_, k in s) for s in sides) < 40:
            return -1.0
        weight = [(np.array(sizes(s)) * w).sum() for s in sides]
        return gini(sizes(some)) - sum(v * gini(sizes(s)) for v, s in zip(weight, sides)) / sum(weight)

    inside = {0: rows}
    for i in (0, 1, 2):
        f, b, g, n = tree[i]
        assert list(n) == sizes(inside[i]) and f >= 0 and g == pytest.approx(gain(inside[i], f, b))
        # No other bin of the feature does better.
        assert g >= max(gain(inside[i], f, c) for c in range(31)) - 1e-12
        inside[2 * i + 1] = [r for r in inside[i] if r[0][f] <= b]
        inside[2 * i + 2] = [r for r in inside[i] if r[0][f] > b]


def test_the_model_scores_as_its_trees(spark):
    df = frame(spark)
    est = RandomForestClassifier(numTrees=5, maxDepth=4, minInstancesPerNode=3, seed=1)
    data, w = fo.binned(df, ["x", "y", "z"], F.col("label")), np.array([1.0, 3.0])
    trees = fo.grow(data, 0, w, fo.Forest(5, 4, 3, 1))
    model = fo.as_model(data, trees, w, est)
    assert model.stages[-1].getNumTrees == 5 and model.stages[-1].getMaxDepth() == 4 and model.stages[-1].featureImportances.toArray().sum() == pytest.approx(1)
    kept = [fo._rows(t, data.cuts, w) for t in trees]
    for rows in kept:
        for r in rows:  # leaves of one parent differ
            pair = [rows[r[c]] for c in ("leftChild", "rightChild")] if r["leftChild"] >= 0 else []
            assert not (pair and all(p["leftChild"] < 0 for p in pair) and pair[0]["prediction"] == pair[1]["prediction"])
    for r in model.transform(df.limit(50)).collect():
        p = np.zeros(2)
        for rows in kept:
            at = rows[0]
            while at["leftChild"] >= 0:
                s = at["split"]
                at = rows[at["leftChild" if r["features"][s["featureIndex"]] <= s["leftCategoriesOrThreshold"][0] else "rightChild"]]
            p += np.array(at["impurityStats"]) / sum(at["impurityStats"])
        assert r["probability"].toArray() == pytest.approx(p / 5)


def test_large_frames_get_the_same_kind_of_forest(spark, monkeypatch):
    df = frame(spark)
    config = {"algorithm": "random_forest", "params": {"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 1}}
    fit = lambda: tn.train_configured(df, ["x", "y", "z"], "id", config).model
    mllib, used, own = fit(), [], fo.fit
    monkeypatch.setattr(fo, "LARGE_ROWS", 1000)
    monkeypatch.setattr(fo, "fit", lambda *a: used.append(a) or own(*a))
    large, test, auc = fit(), frame(spark, 4000, 8), BinaryClassificationEvaluator()
    assert len(used) == 1 and used[0][2] == pytest.approx({r["label"]: r["weight"] for r in ml.class_weights(df, "label").select("label", "weight").distinct().collect()})
    a, b = (auc.evaluate(m.transform(test)) for m in (mllib, large))
    assert abs(a - b) < 0.02 and b > 0.6
    assert large.stages[-1].featureImportances.toArray() == pytest.approx(mllib.stages[-1].featureImportances.toArray(), abs=0.08)
    # Deeper forests, and frames that are not large, stay with MLlib.
    assert not fo.takes(RandomForestClassifier(numTrees=2, maxDepth=20), 10**9) and not fo.takes(RandomForestClassifier(numTrees=2), 1000)


def test_denial_reasons_of_large_frames(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, float(x := rng.random()), [c for c, at in ((1, 0.5), (2, 0.8)) if x > at] or [3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, x double, denial_codes array<int>")
    monkeypatch.setattr(fo, "LARGE_ROWS", 1000)
    models = ml.denial_reason_models(df, ["x"], trees=5, depth=4)
    assert set(models) == {1, 2, 3}
    for code, m in models.items():
        p = m.transform(df).select(F.array_contains("denial_codes", code).cast("double").alias("label"), "rawPrediction")
        assert BinaryClassificationEvaluator().evaluate(p) > 0.97, code
