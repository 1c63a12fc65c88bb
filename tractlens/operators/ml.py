"""Models on tables.

MLlib estimators do the distributed work (histogram aggregation for trees,
treeAggregate for logistic regression).  Driver-side loops run only over
model types, candidate years and labels - never over rows.  Feature vectors
are assembled once and persisted while a model family iterates over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.functions.columns import clip
from tractlens.functions.frames import partitioned, pooled, training_frame
from tractlens.functions.stats import materialize_small
from tractlens.operators import rules as R
from tractlens.operators.splits import id_order, id_order_sql, stratified_parts

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
TEST_FRACTION = 0.2
SEED = 42
MIN_TRAIN_ROWS = 20
DEFAULT_FEATURES = ["income", "loan_amount", "property_value", "credit_score", "debt_to_income_ratio",
                    "loan_to_value_ratio"]
#: The reference's grids, as far as MLlib's estimators have the parameter.
OUTCOME_GRIDS = {
    "logistic_regression": {"regParam": [100.0, 10.0, 1.0, 0.1, 0.01], "elasticNetParam": [1.0, 0.0]},
    "random_forest": {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4],
                      "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "gbt": {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.15, 0.2], "maxDepth": [3, 5, 7, 10],
            "minInstancesPerNode": [1, 2, 4], "subsamplingRate": [0.8, 0.9, 1.0]},
}
# ---------------------------------------------------------------------------


def hash_uniform(id_col: str | Column, seed: int = SEED) -> Column:
    """Deterministic per-row uniform number in [0, 1) from the row key."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def id_uniform(id_col: str | Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) from a whole-number key, in integer arithmetic that any SQL engine repeats."""
    return id_order(F.col(id_col) if isinstance(id_col, str) else id_col, seed) / F.lit(float(1 << 31))


def id_uniform_sql(id_sql: str, seed: int = SEED) -> str:
    return f"{id_order_sql(id_sql, seed)} / 2147483648.0"


def stratified_split(df: DataFrame, id_col: str, label: str = "label", test_fraction: float = TEST_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """L1: adds ``is_test``; each class has exactly its share of test rows (see ``operators.splits``)."""
    parts = stratified_parts(df, id_col, label, test_fraction, seed=seed, out="_part")
    return parts.withColumn("is_test", (F.col("_part") == "test").cast("int")).drop("_part")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weight n / (k * n_class); the per-class table has k rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))
    tot = counts.agg(F.sum("_n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_n_c"))).alias(out))
    return df.join(F.broadcast(w), label, "left")


def undersample(df: DataFrame, label: str, id_col: str = "application_id", ratio: float = 1.0, seed: int = SEED) -> DataFrame:
    """Keep the minority class, thin the others down to ``ratio`` x minority in expectation,
    by each row's own uniform number (the class counts are a k-row aggregate)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df
    minority = min(counts.values())
    share = F.lit(1.0)
    for k, n in counts.items():
        share = F.when(F.col(label) == k, F.lit(min(1.0, minority * ratio / n) if n != minority else 1.0)).otherwise(share)
    return df.filter(id_uniform(id_col, seed + 1) < share)


def _assembler(features: Sequence[str], out: str = "features"):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def _prepared(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The temporal models' fill: missing panel values are 0, as in the reference."""
    return df.na.fill(0.0, subset=list(features))


def _imputed(features: Sequence[str], out: str = "features") -> list:
    """B20 as pipeline stages: each feature's median, learnt from the training rows, in a
    column of its own; tiers, reasons and tables keep reading the original, possibly null ones."""
    from pyspark.ml.feature import Imputer

    names = [f"_imp_{c}" for c in features]
    return [Imputer(strategy="median", inputCols=list(features), outputCols=names), _assembler(names, out)]


def _numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def _without_model_columns(df: DataFrame) -> DataFrame:
    return df.drop("features", "_raw", "rawPrediction", "probability", *[c for c in df.columns if c.startswith("_imp_")])


def outcome_models(train: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None,
                   model_types: Sequence[str] = ("logistic_regression", "random_forest", "gbt"),
                   grids: dict[str, dict[str, list]] | None = None, folds: int = 3, parallelism: int = 4,
                   seed: int = SEED) -> dict:
    """One cross-validated pipeline per model type over ``grids`` (the reference's
    by default), scored by F1.  Returns {name: fitted CrossValidatorModel}."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    grids = grids or OUTCOME_GRIDS
    data = training_frame(_numeric(train, features))
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    out = {}
    for name in model_types:
        kw = {"labelCol": label, "featuresCol": "features"}
        if weight:
            kw["weightCol"] = weight
        if name == "logistic_regression":
            est = LogisticRegression(maxIter=1000, **kw)
            stages = [*_imputed(features, "_raw"), StandardScaler(inputCol="_raw", outputCol="features",
                                                                  withMean=True, withStd=True), est]
        else:
            est = (RandomForestClassifier if name == "random_forest" else GBTClassifier)(seed=seed, **kw)
            stages = [*_imputed(features), est]
        grid = ParamGridBuilder()
        for param, values in grids[name].items():
            grid = grid.addGrid(est.getParam(param), values)
        cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid.build(), evaluator=ev,
                            numFolds=folds, parallelism=parallelism, seed=seed)
        out[name] = cv.fit(data)
    data.unpersist()
    return out


def classification_metrics(pred: DataFrame, label: str = "label", model_name: str = "model") -> DataFrame:
    """Accuracy, weighted precision / recall / F1, F1 of class 1 and AUC as a one-row table."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    # Scored once; each of the measures reads the scores.
    pred = materialize_small(pred.select(label, "prediction", "rawPrediction"))
    vals = {}
    for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1"):
        vals[m] = MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(pred)
    vals["f1_class1"] = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel",
                                                          metricLabel=1.0).evaluate(pred)
    try:
        vals["auc"] = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction").evaluate(pred)
    except Exception:  # noqa: BLE001 - single-class test sets have no AUC
        vals["auc"] = None
    spark = pred.sparkSession
    return spark.createDataFrame([(model_name, *[None if v is None else round(float(v), 4) for v in vals.values()])],
                                 "model string, accuracy double, precision double, recall double, f1 double, "
                                 "f1_class1 double, auc double")


def confusion_matrix(pred: DataFrame, label: str = "label") -> DataFrame:
    """Counts per (label, prediction)."""
    return pred.groupBy(F.col(label).cast("int").alias("label"),
                        F.col("prediction").cast("int").alias("prediction")).count()


def model_summary(metrics: DataFrame) -> DataFrame:
    """One row per model plus ``is_best`` (highest F1, ties by name)."""
    best = metrics.agg(F.min_by("model", F.struct(-F.col("f1"), F.col("model"))).alias("_best"))
    return metrics.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("model") == F.col("_best")).drop("_best")


def batch_score(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Outcome, approval probability, confidence, risk level, recommendation,
    rule denial reasons (denied rows) or risk warnings (approved rows), risk tiers."""
    from pyspark.ml.functions import vector_to_array

    from tractlens.operators.features import risk_tiers

    scored = model.transform(_numeric(df, features))
    p = vector_to_array(F.col("probability"))[1]
    reasons = R.rule_denial_reasons(F.col("debt_to_income_ratio"), F.col("loan_to_value_ratio"),
                                    F.col("credit_score"), F.col("income") * 1000, F.col("loan_amount"),
                                    F.col("property_value"))
    out = scored.withColumns({
        "approval_probability": p,
        "predicted_outcome": F.when(F.col("prediction") == 1, "Approved").otherwise("Denied"),
        "confidence": F.greatest(p, F.lit(1.0) - p),
        "risk_level": R.probability_risk_level(p),
        "recommendation": R.recommendation(p, F.col("debt_to_income_ratio"), F.col("loan_to_value_ratio") / 100),
    })
    out = out.withColumn("denial_reasons", F.when(F.col("prediction") == 0, reasons)) \
             .withColumn("risk_warnings", F.when(F.col("prediction") == 1, R.risk_warnings(reasons)))
    out = risk_tiers(out)
    return _without_model_columns(out)


def feature_importance(model, names: Sequence[str], k: int = 10) -> DataFrame:
    """Tree importances (or |coefficients| for linear models), top k, with K17 impact level."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(stage, "featureImportances"):
        vals = stage.featureImportances.toArray().tolist()
    else:
        vals = [abs(float(x)) for x in stage.coefficients.toArray().tolist()]
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, vals)], "feature string, importance double")
    return (df.orderBy(F.desc("importance"), "feature").limit(k)
              .withColumn("impact_level", R.impact_level(F.col("importance"))))


def denial_reason_models(denied: DataFrame, features: Sequence[str], codes_col: str = "denial_codes",
                         min_positive: int = 5, seed: int = SEED, trees: int = 100, depth: int = 10) -> dict:
    """One random forest per reason code with at least ``min_positive``
    positive rows (multi-label, one model per label), with balanced class weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier

    from tractlens.operators import forest as fo

    data = materialize_small(_numeric(denied, features).select(codes_col, *features))
    rows = data.count()
    forest = RandomForestClassifier(labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    large = fo.takes(forest, rows)
    if not large:
        data = partitioned(data, rows)
    pos = data.select(F.explode(F.array_distinct(F.col(codes_col))).alias("code")).groupBy("code").count()
    positive = {int(r["code"]): r["count"] for r in pos.filter(F.col("count") >= min_positive).collect()
                if r["code"] is not None and 1 <= int(r["code"]) <= 9}
    eligible = sorted(positive)
    if large and eligible:
        # Binned once for all reasons: a bit of the labels is a reason.
        has = [F.coalesce(F.array_contains(F.col(codes_col), c), F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(eligible)]
        binned = fo.binned(data, features, reduce(lambda a, b: a + b, has))
        weights = {c: fo.balanced({0: rows - positive[c], 1: positive[c]}) for c in eligible}
        return dict(zip(eligible, pooled([lambda i=i, c=c: fo.fit(binned, i, weights[c], forest) for i, c in enumerate(eligible)])))

    def fit(code: int):
        lab = class_weights(data.withColumn("_y", F.array_contains(F.col(codes_col), code).cast("double")), "_y", "_w")
        return Pipeline(stages=[*_imputed(features), forest]).fit(lab)

    models = dict(zip(eligible, pooled([lambda c=c: fit(c) for c in eligible])))
    data.unpersist()
    return models


def predict_denial_reasons(models: dict, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """L14 scoring + K15: per-reason probabilities, likely reasons (> 0.5) and the primary reason."""
    from pyspark.ml.functions import vector_to_array

    out = _numeric(df, features)
    names = []
    for code, m in models.items():
        out = _without_model_columns(
            m.transform(out).withColumn(f"_p_{code}", vector_to_array("probability")[1])).drop("prediction")
        names.append(code)
    if not names:
        return out.withColumn("denial_explanation", F.lit(None))
    probs = F.array(*[F.col(f"_p_{c}") for c in names])
    labels = [R.DENIAL_LABELS.get(c, R.UNKNOWN_REASON) for c in names]
    return out.withColumn("denial_explanation", R.denial_explanations(probs, labels)) \
              .drop(*[f"_p_{c}" for c in names])


# Temporal regressors ------------------------------------------------------------
def temporal_models(temporal: DataFrame, features: Sequence[str], label: str = "opportunity_score",
                    min_rows: int = MIN_TRAIN_ROWS, seed: int = SEED,
                    years: Sequence[int] | None = None, trees: int = 50, rounds: int = 50) -> tuple[DataFrame, dict]:
    """L4: for each training year, fit random forest and GBT regressors on all
    rows up to that year (hash 80/20 split), evaluate R2 / MSE / MAE, keep the
    best by R2.  Returns (metrics table, {year: (best name, fitted model)})."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    data = training_frame(_prepared(temporal, features).select(
        "year", label, *features, hash_uniform(F.concat_ws("|", "census_tract", "year"), seed).alias("_u")))
    sizes = {r["year"]: r["count"] for r in data.groupBy("year").count().collect()}
    make = {"random_forest": lambda: RandomForestRegressor(labelCol=label, numTrees=trees, seed=seed),
            "gbt": lambda: GBTRegressor(labelCol=label, maxIter=rounds, seed=seed)}
    scorers = {k: RegressionEvaluator(labelCol=label, metricName=k) for k in ("r2", "mse", "mae")}

    def fit(y: int, name: str):
        sub = data.filter(F.col("year") <= y)
        m = Pipeline(stages=[_assembler(features), make[name]()]).fit(sub.filter(F.col("_u") >= TEST_FRACTION))
        p = m.transform(sub.filter(F.col("_u") < TEST_FRACTION))
        return m, {k: float(ev.evaluate(p)) for k, ev in scorers.items()}

    runs = [(y, name) for y in sorted(sizes if years is None else years)
            if sum(n for k, n in sizes.items() if k <= y) >= min_rows for name in make]
    fitted = pooled([lambda y=y, n=n: fit(y, n) for y, n in runs])
    data.unpersist()
    best: dict = {}
    for (y, name), (m, ev) in zip(runs, fitted):
        if y not in best or ev["r2"] > best[y][2]:
            best[y] = (name, m, ev["r2"])
    metrics = temporal.sparkSession.createDataFrame(
        [(int(y), name, ev["r2"], ev["mse"], ev["mae"]) for (y, name), (_, ev) in zip(runs, fitted)],
        "year int, model string, r2 double, mse double, mae double")
    return metrics, {y: (n, m) for y, (n, m, _) in best.items()}


def predict_future(model, future: DataFrame, features: Sequence[str]) -> DataFrame:
    """clip(prediction, 0, 100) and confidence clip(85 - 5h + 10 strength, 60, 95)."""
    from tractlens.operators.temporal import prediction_confidence

    p = model.transform(_prepared(future, features))
    return p.select("census_tract", "year", "years_ahead", clip(F.col("prediction"), 0, 100).alias("predicted_opportunity_score"),
                    "avg_yoy_change", "trend_strength",
                    prediction_confidence(F.col("years_ahead"), F.coalesce(F.col("trend_strength"), F.lit(0.5)))
                    .alias("prediction_confidence"))


# Fairness and denial patterns ------------------------------------------------------
def fairness_table(scored: DataFrame, attrs: Sequence[str], label: str = "label") -> DataFrame:
    """per demographic attribute and value: count, actual rate, predicted
    rate, mean probability (4 dp) - on the scored *test* rows (trap T12 fixed)."""
    long = scored.select(label, "prediction", "approval_probability",
                         F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"),
                                                      F.col(a).cast("string").alias("value")) for a in attrs]))
                         .alias("_d")).select(label, "prediction", "approval_probability", "_d.*")
    return long.groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg(F.col(label)), 4).alias("actual_rate"),
        F.round(F.avg("prediction"), 4).alias("predicted_rate"),
        F.round(F.avg("approval_probability"), 4).alias("mean_probability"))


def denial_patterns(denied: DataFrame, groups: Sequence[str], codes_col: str = "denial_codes") -> DataFrame:
    """per group value and reason: count, share of the group's denials, group total."""
    long = denied.select(F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).cast("string").alias("value"))
                                             for g in groups])).alias("_g"), codes_col).select("_g.*", codes_col)
    totals = long.groupBy("group", "value").agg(F.count(F.lit(1)).alias("group_denials"))
    reasons = (long.select("group", "value", F.explode(F.array_distinct(F.col(codes_col))).alias("code"))
                   .groupBy("group", "value", "code").agg(F.count(F.lit(1)).alias("count")))
    return (reasons.join(totals, ["group", "value"])
                   .withColumn("reason", R.denial_label(F.col("code")))
                   .withColumn("pct_of_group_denials", F.col("count") / F.col("group_denials") * 100))


# L19 / L20 ------------------------------------------------------------------------
def logic_check(model, cases: DataFrame, features: Sequence[str], expected: str = "expected") -> DataFrame:
    """Score a frame of extreme cases (expected 1 = approved, 0 = denied)
    and report the share the model gets right."""
    p = model.transform(_numeric(cases, features))
    return p.agg(F.count(F.lit(1)).alias("cases"),
                 F.avg((F.col("prediction") == F.col(expected)).cast("double")).alias("logic_score"))


def method_comparison(default_metrics: DataFrame, tuned_metrics: DataFrame) -> DataFrame:
    """F1 gain (%) of the tuned run over the default run, per model."""
    d = default_metrics.select("model", F.col("f1").alias("f1_default"))
    t = tuned_metrics.select("model", F.col("f1").alias("f1_tuned"))
    return d.join(t, "model").withColumn(
        "f1_gain_pct", F.when(F.col("f1_default") > 0,
                              (F.col("f1_tuned") - F.col("f1_default")) / F.col("f1_default") * 100))
