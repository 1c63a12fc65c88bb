"""Denial reasons as a target and its metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractlens.functions.frames import training_frame
from tractlens.functions.stats import materialize_small

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference.
DENIED = 3
REASON_CODES = tuple(range(1, 10))
LEAST_ROWS, LEAST_SHARE = 10, 0.01
# Forest of the multi-class model.
PRIMARY_FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2}
# ---------------------------------------------------------------------------
#: Scores are compared to this many decimals, which bounds the distinct scores of a reason.
SCORE_DIGITS = 6


def reason_codes(df: DataFrame, codes: Sequence[int] = REASON_CODES) -> Column:
    """The row's distinct known codes in any ``denial_reason*`` column, ascending; others (n/a) are none."""
    names = [c for c in df.columns if "denial_reason" in c.lower()]
    found = F.array_distinct(F.array(*[F.col(f"`{c}`").try_cast("int") for c in names]))
    return F.array_sort(F.filter(found, lambda x: x.isin(*codes)))


def code_screen(patterns: dict[int, int], codes: Sequence[int], least_rows: int, least_share: float) -> list[int]:
    """Codes that stay, given the rows of each set of codes (a bit each).  A code on fewer than
    max(least_rows, least_share * rows) rows goes; rows without a code left go too, which lowers the
    bar, so the screen repeats until nothing changes."""
    kept = list(codes)
    while True:
        mask = sum(1 << codes.index(c) for c in kept)
        rows = sum(n for p, n in patterns.items() if p & mask)
        count = {c: sum(n for p, n in patterns.items() if p >> codes.index(c) & 1) for c in kept}
        left = [c for c in kept if count[c] >= max(least_rows, least_share * rows)]
        if left == kept:
            return kept
        kept = left


def denial_target(df: DataFrame, codes: Sequence[int] = REASON_CODES, least_rows: int = LEAST_ROWS,
                  least_share: float = LEAST_SHARE, vector: str = "target") -> tuple[DataFrame, list[int]]:
    """Denied rows that name a reason that stays, with a sparse multi-hot vector over the kept
    codes, and these codes.

    The rows of each set of codes are one partial aggregate of at most ``2 ** len(codes)`` rows
    (no bigger than that whatever the data), on which the screen is iterated; nothing else is collected."""
    from pyspark.ml.feature import CountVectorizerModel

    if len(codes) > 16:
        raise ValueError("the screen keeps one row for each set of codes")
    rows = df.filter(F.col("action_taken") == DENIED).withColumn("_codes", reason_codes(df, codes)).filter(F.size("_codes") > 0)
    bit = lambda x: F.pow(F.lit(2.0), F.array_position(F.array(*map(F.lit, codes)), x) - 1).cast("int")
    sets = rows.select(F.aggregate("_codes", F.lit(0), lambda acc, x: acc.bitwiseOR(bit(x))).alias("set"))
    patterns = {r["set"]: r["count"] for r in sets.groupBy("set").count().collect()}
    kept = code_screen(patterns, list(codes), least_rows, least_share)
    rows = rows.withColumn("_codes", F.filter("_codes", lambda x: x.isin(*kept) if kept else F.lit(False))).filter(F.size("_codes") > 0)
    if not kept:
        return rows.withColumn(vector, F.lit(None)).withColumnRenamed("_codes", "codes"), kept
    named = rows.withColumn("_names", F.transform("_codes", lambda x: x.cast("string")))
    hot = CountVectorizerModel.from_vocabulary([str(c) for c in kept], inputCol="_names", outputCol=vector).setBinary(True)
    return hot.transform(named).drop("_names").withColumnRenamed("_codes", "codes"), kept


# Metrics --------------------------------------------------------------------------
def reason_metrics(pred: DataFrame, code: str = "code", truth: str = "truth", predicted: str = "predicted",
                   score: str = "score") -> DataFrame:
    """L14 per reason, over rows of (code, truth 0/1, predicted 0/1, score): counts of a confusion
    matrix, precision, recall, F1 and AUC; where the reason never, or always, holds, these are 0.

    AUC counts pairs through running counts over the distinct scores (to 6 decimals, so a
    reason has at most a million), of which ties count half."""
    y, p = F.col(truth), F.col(predicted)
    both = lambda a, b: F.count_if((y == a) & (p == b))
    # One pass over the rows, which may score many models; the rest reads the steps' counts.
    steps = materialize_small(pred.groupBy(code, F.floor(F.col(score) * float(10**SCORE_DIGITS) + 0.5).alias("_s")).agg(
        F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"), both(1, 1).alias("tp"), both(0, 1).alias("fp"),
        both(1, 0).alias("fn"), both(0, 0).alias("tn")))
    counts = steps.groupBy(code).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    below = F.sum("_n").over(Window.partitionBy(code).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    pairs = steps.withColumn("_below", F.coalesce(below, F.lit(0))).groupBy(F.col(code).alias("_c")).agg(
        F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_u"), (F.sum("_p") * F.sum("_n")).alias("_all"))
    seen = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    zero = lambda x: F.when(seen, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    tp = F.col("tp").cast("double")
    return counts.join(pairs, F.col(code) == F.col("_c")).select(
        code, "tp", "fp", "fn", "tn", zero(F.try_divide(tp, F.col("tp") + F.col("fp"))).alias("precision"),
        zero(F.try_divide(tp, F.col("tp") + F.col("fn"))).alias("recall"),
        zero(F.try_divide(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        zero(F.try_divide(F.col("_u"), F.col("_all"))).alias("auc"))


def multilabel_summary(per_reason: DataFrame) -> DataFrame:
    """L14 over all reasons: Hamming loss, macro F1 and F1 weighted by how often a reason holds."""
    support = F.col("tp") + F.col("fn")
    return per_reason.agg(
        F.count(F.lit(1)).alias("reasons"),
        (F.sum(F.col("fp") + F.col("fn")) / F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("hamming_loss"),
        F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * support), F.sum(support)).alias("weighted_f1"))


def class_metrics(pred: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """L14 multi-class: accuracy, macro and weighted F1 from one confusion aggregate (a row for
    each pair of classes that occurs)."""
    cells = pred.groupBy(F.col(label).cast("int").alias("y"), F.col(predicted).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    side = lambda c, truth, said, hit: F.struct(F.col(c).alias("c"), truth.alias("truth"), said.alias("said"), hit.alias("hit"))
    sides = cells.select(F.explode(F.array(
        side("y", F.col("n"), none, F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(none)), side("p", none, F.col("n"), none))).alias("x")).select("x.*")
    per = sides.groupBy("c").agg(F.sum("truth").alias("truth"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    f1 = 2.0 * F.col("hit") / (F.col("truth") + F.col("said"))
    return per.agg(F.count(F.lit(1)).alias("classes"), (F.sum("hit") / F.sum("truth")).alias("accuracy"), F.avg(f1).alias("macro_f1"),
                   (F.sum(f1 * F.col("truth")) / F.sum("truth")).alias("weighted_f1"))


def reason_frame(models: dict, df: DataFrame, features: Sequence[str], codes: str = "codes") -> DataFrame:
    """``(code, truth, predicted, score)`` of every row and modelled reason, for ``reason_metrics``."""
    from pyspark.ml.functions import vector_to_array

    out = df.withColumns({c: F.col(c).cast("double") for c in features})
    cells = []
    for code, model in models.items():
        out = model.transform(out).withColumn(f"_p{code}", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction", *[f"_imp_{c}" for c in features])
        cells.append(F.struct(F.lit(code).alias("code"), F.array_contains(F.col(codes), code).cast("int").alias("truth"),
                              (F.col(f"_p{code}") > 0.5).cast("int").alias("predicted"), F.col(f"_p{code}").alias("score")))
    return out.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


# Multi-class model -----------------------------------------------------------------
def primary_reason_model(train: DataFrame, features: Sequence[str], reason: str = "denial_reason_1", seed: int = 42,
                         **forest: int) -> PipelineModel:
    """One forest over the primary reason of denied rows; classes get balanced weights, gaps
    their median.  The features are binned once, for all classes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer

    from tractlens.operators.ml import _imputed, class_weights

    known = train.filter(F.col(reason).isNotNull()).withColumns(
        {**{c: F.col(c).cast("double") for c in features}, "_reason": F.col(reason).cast("string")})
    data = training_frame(class_weights(known.select("_reason", *features), "_reason", "_w"))
    index = StringIndexer(inputCol="_reason", outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(data)
    grown = RandomForestClassifier(labelCol="_label", weightCol="_w", seed=seed, **(PRIMARY_FOREST | forest))
    fitted = Pipeline(stages=[*_imputed(features), grown]).fit(index.transform(data))
    data.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="predicted_reason", labels=[*index.labels, "__unknown"])
    return PipelineModel(stages=[*fitted.stages, back])


def predict_primary_reason(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in features}))
    return out.withColumn("predicted_reason", F.col("predicted_reason").try_cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction", *[f"_imp_{c}" for c in features])
