"""Splits, search budgets, denial targets and metrics against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tractlens.functions.frames import pooled, training_frame
from tractlens.operators import denial as dn
from tractlens.operators import ml
from tractlens.operators import splits as sp
from tractlens.operators import tuning as tn
from tractlens.plans.models import FEATURES, labelled


def order(i, seed=42):
    x = (i % 2**31 * 1103515245 + 12345 + seed) % 2**31
    return ((x ^ x >> 16) * 69069 + 1) % 2**31


@pytest.mark.parametrize("partitions", [1, 9])
def test_three_way_split_takes_exact_ranks(spark, partitions):
    rng = random.Random(3)
    rows = [(i * 7 + 1, rng.choice(["big"] * 30 + ["mid", "mid", None])) for i in range(3000)] + [(10**12, "single"), (5 * 10**9, "pair"), (6, "pair")]
    df = spark.createDataFrame(rows, "id long, label string").repartition(partitions)
    got = {r["id"]: r["part"] for r in sp.stratified_parts(df, "id", "label", 0.2, 0.1).collect()}
    for label in {x for _, x in rows}:
        ids = sorted((i for i, x in rows if x == label), key=lambda i: (order(i), i))
        a = int(len(ids) * 0.2 + 0.5)
        b = a + int((len(ids) - a) * 0.1 + 0.5)
        assert [got[i] for i in ids] == ["test"] * a + ["validation"] * (b - a) + ["train"] * (len(ids) - b), label
    assert sp.stratified_parts(df.limit(0), "id", "label").count() == 0


def test_rows_of_one_hash_are_told_apart_by_id(spark):
    # Ids that agree modulo 2^31 have one hash.
    rows = [(5 + k * 2**31, "x") for k in range(10)]
    got = {r["id"]: r["part"] for r in sp.stratified_parts(spark.createDataFrame(rows, "id long, label string"), "id", "label").collect()}
    assert [got[i] for i, _ in rows] == ["test"] * 2 + ["train"] * 8


def test_training_frames_have_few_partitions(spark):
    assert training_frame(spark.range(1233).repartition(200)).rdd.getNumPartitions() == 1
    big = training_frame(spark.range(20_000).repartition(200))
    assert 1 < big.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and big.count() == 20_000
    assert pooled([lambda i=i: i * i for i in range(9)]) == [i * i for i in range(9)]


def test_points_and_survivors_repeat():
    grid = {"a": [1, 2, 3], "b": [10, 20, 30], "c": [0, 1]}
    points = tn.draw_points(grid, 5, 42)
    assert points == tn.draw_points(dict(reversed(grid.items())), 5, 42) and len({tuple(p.items()) for p in points}) == 5
    assert points != tn.draw_points(grid, 5, 43) and len(tn.draw_points(grid, 99, 1)) == 18
    assert tn.survivors([0.1, 0.9, 0.9, 0.5, 0.2, 0.8], 3) == [1, 2] and tn.survivors([0.3], 3) == [0]


def test_halving_search_repeats_and_refits_the_winner(spark):
    train = labelled(spark, SF001).filter("is_test = 0")
    budget = tn.Budget(points=4, shares=(0.5, 1.0), eta=2, parallelism=2)
    grid = {"numTrees": [5, 10], "maxDepth": [2, 4, 6]}
    alone = tn.halving_search(train, FEATURES, "random_forest", grid, "application_id", budget=tn.Budget(points=2, shares=(0.5, 1.0), eta=2))
    assert [r for r, *_ in alone.trials] == [0, 0]  # nothing is left to tell apart
    runs = [tn.halving_search(df, FEATURES, "random_forest", grid, "application_id", budget=budget) for df in (train, train.repartition(5))]
    shape = [[(r, p, share) for r, p, _, share, _ in run.trials] for run in runs]
    # Points, rungs and their rows repeat; a forest's bootstrap depends on the order of rows, and so may the survivors.
    assert shape[0][:4] == shape[1][:4] and all([r for r, *_ in x] == [0] * 4 + [1] * 2 for x in shape)
    second = [t for t in runs[0].trials if t[0] == 1]
    assert runs[0].best == max(second, key=lambda t: (t[4], -t[1]))[2]
    assert runs[0].model.stages[-1].getNumTrees == runs[0].best["numTrees"]
    assert runs[0].table(spark, "rf").count() == 6


def test_outcome_models_search_whole_grids_on_all_training_rows(spark, monkeypatch):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from tractlens.plans import models as plans

    grids = {"logistic_regression": {"regParam": [1.0, 0.1]}, "random_forest": {"numTrees": [2, 3], "maxDepth": [2, 3]},
             "gbt": {"maxIter": [1, 2, 3], "maxDepth": [1, 2]}}
    found, search = {}, tn.halving_search
    monkeypatch.setattr(ml, "OUTCOME_GRIDS", grids)
    monkeypatch.setattr(plans.tn, "halving_search", lambda rows, features, name, *a, **k: found.setdefault(name, search(rows, features, name, *a, **k)))
    assert plans.l12(spark, SF001).count() == 3
    for name, grid in grids.items():
        tried = [(tuple(sorted(point.items())), share) for _, _, point, share, _ in found[name].trials]
        assert sorted(tried) == sorted((tuple(sorted(p.items())), 1.0) for p in tn.draw_points(grid, None, 0)), name
    # Boosting watches no rows apart, and goes all its rounds.
    last = found["gbt"].model.stages[-1]
    assert last.getNumTrees == found["gbt"].best["maxIter"] and not last.isSet("validationIndicatorCol")
    # A score is the mean over five folds that hold every training row once.
    train = ml.class_weights(labelled(spark, SF001).filter("is_test = 0"), "label").withColumn("k", F.floor(tn._uniform("application_id", 43) * 5))
    train = training_frame(ml._numeric(train, FEATURES))
    scorer = MulticlassClassificationEvaluator(metricName="f1")
    for _, _, point, _, score in found["logistic_regression"].trials:
        each = [scorer.evaluate(tn.outcome_pipeline("logistic_regression", FEATURES, "label", "weight", 42, **point).fit(
            train.filter(f"k <> {k}")).transform(train.filter(f"k = {k}"))) for k in range(5)]
        assert score == pytest.approx(sum(each) / 5)


def test_configured_trainer(spark):
    train = labelled(spark, SF001).filter("is_test = 0")
    fixed = tn.train_configured(train, FEATURES, "application_id", {"algorithm": "logistic_regression", "params": {"regParam": 0.01}})
    assert fixed.best == {"regParam": 0.01, "elasticNetParam": 0.0} and not fixed.trials
    tuned = tn.train_configured(train, FEATURES, "application_id", {"algorithm": "gbt", "balanced": False, "tuning": {
        "grid": {"maxIter": [2, 3], "maxDepth": [2]}, "budget": {"points": 2, "shares": (1.0,)}}})
    assert len(tuned.trials) == 2
    with pytest.raises(ValueError, match="svm"):
        tn.train_configured(train, FEATURES, "application_id", {"algorithm": "svm"})


def test_selection_over_time_refits_the_best(spark):
    rng = random.Random(1)
    rows = [(f"t{t}", 2000 + y, float(x := rng.random() * 50), 2.0 * x + 1) for t in range(20) for y in range(5)]
    df = spark.createDataFrame(rows, "census_tract string, year int, x double, opportunity_score double")
    got = tn.select_over_time(df, ["x"], trees=5, rounds=5)
    table = {r["model"]: r for r in got.table.collect()}
    assert got.name == "linear" and table["linear"]["is_best"] and table["linear"]["refit_r2"] > 0.999 and table["linear"]["refit_rows"] == 100
    assert all(r["folds"] == 3 for r in table.values()) and table["gbt"]["refit_r2"] is None
    with pytest.raises(ValueError):
        tn.select_over_time(df.filter("year = 2000"), ["x"])


# Denial target -------------------------------------------------------------------------
def test_screen_repeats_until_nothing_changes():
    codes = [1, 2, 3]
    # 3 is rare; without its rows the bar falls, and 2, which was under it, stays out all the same.
    assert dn.code_screen({0b001: 80, 0b010: 15, 0b100: 5}, codes, 10, 0.16) == [1]
    assert dn.code_screen({0b001: 80, 0b011: 15, 0b100: 12}, codes, 10, 0.12) == [1, 2]
    assert dn.code_screen({0b001: 3}, codes, 10, 0.0) == [] and dn.code_screen({}, codes, 0, 0.5) == codes


def test_denial_target_drops_what_names_no_reason(spark):
    rows = [(i, 3, "1", 10) for i in range(12)] + [(100, 3, "10", None), (101, 3, None, None), (102, 1, "1", None), (103, 3, "2", 1), (104, 3, "x", 2)]
    df = spark.createDataFrame(rows, "id int, action_taken int, `denial_reason-1` string, `denial_reason-2` int")
    out, kept = dn.denial_target(df)
    assert kept == [1] and {r["id"]: r["codes"] for r in out.collect()} == {i: [1] for i in [*range(12), 103]}
    both, kept = dn.denial_target(df, least_rows=1, least_share=0.0)
    assert kept == [c for c in dn.REASON_CODES if c < 3] or kept == [1, 2]
    assert {tuple(r["target"].toArray()) for r in both.filter("id IN (103, 104)").collect()} == {(1.0, 1.0), (0.0, 1.0)}
    none, kept = dn.denial_target(df.filter("id = 100"))
    assert none.count() == 0


def brute_metrics(rows):
    out = {}
    for code in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == code]
        c = Counter((t, p) for _, t, p, _ in own)
        tp, fp, fn, tn_ = c[1, 1], c[0, 1], c[1, 0], c[0, 0]
        pos, neg = [s for _, t, _, s in own if t], [s for _, t, _, s in own if not t]
        if pos and neg:
            auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
            values = (tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), auc)
        else:
            values = (0.0,) * 4
        out[code] = (tp, fp, fn, tn_, *values)
    return out


def test_metrics_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(code, t, int(s > 0.5), s) for code in range(1, 5) for _ in range(60)
            for t in [int(code != 4 and rng.random() < 0.2 * code)] for s in [round(0.3 * t + 0.6 * rng.random(), 1)]]
    want = brute_metrics(rows)
    per = dn.reason_metrics(spark.createDataFrame(rows, "code int, truth int, predicted int, score double"))
    got = {r["code"]: tuple(r)[1:] for r in per.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    s = dn.multilabel_summary(per).first()
    wrong = sum(w[1] + w[2] for w in want.values())
    assert s["hamming_loss"] == pytest.approx(wrong / len(rows)) and s["macro_f1"] == pytest.approx(sum(w[6] for w in want.values()) / 4)
    pairs = [(rng.randrange(4), rng.randrange(5)) for _ in range(200)]
    classes = {c for p in pairs for c in p}
    f1 = {c: 2 * sum(a == b == c for a, b in pairs) / sum((a == c) + (b == c) for a, b in pairs) for c in classes}
    m = dn.class_metrics(spark.createDataFrame(pairs, "label int, prediction int")).first()
    assert m["classes"] == len(classes) and m["accuracy"] == pytest.approx(sum(a == b for a, b in pairs) / 200)
    assert m["macro_f1"] == pytest.approx(sum(f1.values()) / len(classes))
    assert m["weighted_f1"] == pytest.approx(sum(f1[a] for a, _ in pairs) / 200)


def test_primary_reason_model_learns_a_rule(spark):
    rng = random.Random(4)
    rows = [(i, float(x := rng.random()), None if i % 11 == 0 else float(rng.random()), 3 if x > 0.6 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double, denial_reason_1 int")
    model = dn.primary_reason_model(df, ["x", "y"], numTrees=10, maxDepth=4)
    said = dn.predict_primary_reason(model, df, ["x", "y"])
    assert dn.class_metrics(said, "denial_reason_1", "predicted_reason").first()["accuracy"] > 0.95


def test_reason_models_give_rows_for_the_metrics(spark):
    rng = random.Random(5)
    rows = [(i, float(x := rng.random()), [c for c, at in ((1, 0.5), (2, 0.8)) if x > at] or [3]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, denial_codes array<int>")
    models = ml.denial_reason_models(df, ["x"], trees=5, depth=4)
    frame = dn.reason_frame(models, df, ["x"], "denial_codes")
    assert frame.count() == 200 * len(models) and set(models) == {1, 2, 3}
    assert {r["code"]: r["auc"] > 0.9 for r in dn.reason_metrics(frame).collect()} == {1: True, 2: True, 3: True}
    assert frame.agg(F.max("score")).first()[0] <= 1.0
