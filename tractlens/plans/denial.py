"""Denial-reason target and metrics as registered queries.

The metric queries run on a prediction frame without a model: scores are hashes of the row's id,
shifted towards the truth, so that SQL can compute the same metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tractlens.functions.stats import materialize_small
from tractlens.operators import denial as dn
from tractlens.operators import ml
from tractlens.oracle.views import APPLICATIONS, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.plans.validation import model_input
from tractlens.sources.tables import applications

_DENIED = f"""
den AS (SELECT * FROM (
  SELECT application_id, denial_reason_1, list_sort(list_distinct(list_filter([denial_reason_1, denial_reason_2], lambda x: x BETWEEN 1 AND 9))) AS codes
  FROM applications WHERE action_taken = {dn.DENIED}) WHERE len(codes) > 0)"""


def _screen_ctes(share: float) -> list[str]:
    """The screen, written out as often as it can change something."""
    codes = ", ".join(map(str, dn.REASON_CODES))
    out = [f"n_code AS (SELECT c, count(*) AS n FROM (SELECT unnest(codes) AS c FROM den) GROUP BY c)", f"k0 AS (SELECT [{codes}] AS kept)"]
    for i in range(len(dn.REASON_CODES)):
        out.append(f"""k{i + 1} AS (SELECT coalesce(list(c ORDER BY c), []) AS kept FROM n_code, k{i}, (
          SELECT count(*) AS total FROM den, k{i} WHERE len(list_filter(codes, lambda x: list_contains(kept, x))) > 0)
          WHERE list_contains(kept, c) AND n >= greatest({dn.LEAST_ROWS}, {share} * total))""")
    return out


def _target_sql(share: float) -> str:
    last = f"k{len(dn.REASON_CODES)}"
    return with_ctes(APPLICATIONS, _DENIED, *_screen_ctes(share), body=f"""
SELECT application_id, array_to_string(list_filter(codes, lambda x: list_contains(kept, x)), ',') AS codes, array_to_string(kept, ',') AS kept,
       array_to_string(list_transform(kept, lambda k: CAST(list_contains(codes, k) AS INT)), ',') AS target
FROM den, {last} WHERE len(list_filter(codes, lambda x: list_contains(kept, x))) > 0""")


def _target(spark, sf, share):
    a = applications(spark, sf).select("application_id", "action_taken", "denial_reason_1", "denial_reason_2")
    rows, kept = dn.denial_target(a, least_share=share)
    hot = F.transform(vector_to_array("target"), lambda x: x.cast("int"))
    return rows.select("application_id", F.array_join("codes", ",").alias("codes"), F.lit(",".join(map(str, kept))).alias("kept"),
                       F.array_join(hot, ",").alias("target"))


@register("k16_denial_target", _target_sql(dn.LEAST_SHARE))
def k16(spark, sf):
    return _target(spark, sf, dn.LEAST_SHARE)


#: A bar that several reasons of the test tables fall below.
STRICT_SHARE = 0.165


@register("k16_denial_target_strict", _target_sql(STRICT_SHARE))
def k16_strict(spark, sf):
    return _target(spark, sf, STRICT_SHARE)


# L14 metrics on a fixed prediction frame ----------------------------------------------
def _denied(spark, sf):
    a = applications(spark, sf).filter(F.col("action_taken") == dn.DENIED)
    return a.withColumn("codes", dn.reason_codes(a)).filter(F.size("codes") > 0).select("application_id", "denial_reason_1", "codes")


_FRAME = f"""
frame AS (SELECT code, CAST(list_contains(codes, code) AS INT) AS truth, (u + CAST(list_contains(codes, code) AS INT)) / 2.5 AS score FROM (
  SELECT codes, code, {ml.id_uniform_sql("application_id * 16 + code", 7)} AS u
  FROM den, (SELECT unnest([{", ".join(map(str, dn.REASON_CODES))}]) AS code)))"""
_REASONS = f"""
conf AS (SELECT code, count(*) FILTER (truth = 1 AND score > 0.5) AS tp, count(*) FILTER (truth = 0 AND score > 0.5) AS fp,
         count(*) FILTER (truth = 1 AND score <= 0.5) AS fn, count(*) FILTER (truth = 0 AND score <= 0.5) AS tn FROM frame GROUP BY code),
steps AS (SELECT code, floor(score * CAST(1000000 AS DOUBLE) + 0.5) AS s, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM frame GROUP BY 1, 2),
pairs AS (SELECT code, sum(p * (below + n / 2)) AS u, sum(p) * sum(n) AS total FROM (
  SELECT code, p, n, coalesce(sum(n) OVER (PARTITION BY code ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps) GROUP BY code),
reasons AS (
SELECT code, tp, fp, fn, tn, CASE WHEN ok AND tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN ok THEN tp / (tp + fn) ELSE 0 END AS recall,
       CASE WHEN ok THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN ok THEN u / total ELSE 0 END AS auc
FROM (SELECT *, tp + fn > 0 AND fp + tn > 0 AS ok FROM conf) JOIN pairs USING (code))"""


def _frame(spark, sf):
    rows = _denied(spark, sf).select("application_id", "codes", F.explode(F.array(*map(F.lit, dn.REASON_CODES))).alias("code"))
    truth = F.array_contains("codes", F.col("code")).cast("int")
    u = ml.id_uniform(F.col("application_id") * 16 + F.col("code"), 7)
    return rows.select("code", truth.alias("truth"), ((u + truth) / 2.5).alias("score")).withColumn("predicted", (F.col("score") > 0.5).cast("int"))


@register("l14_reason_metrics", rounded(with_ctes(APPLICATIONS, _DENIED, _FRAME, _REASONS, body="SELECT * FROM reasons"),
                                        ["precision", "recall", "f1", "auc"]))
def l14_reason_metrics(spark, sf):
    return finalize(dn.reason_metrics(_frame(spark, sf)))


@register("l14_multilabel_summary", rounded(with_ctes(APPLICATIONS, _DENIED, _FRAME, _REASONS, body="""
SELECT count(*) AS reasons, sum(fp + fn) / sum(tp + fp + fn + tn) AS hamming_loss, avg(f1) AS macro_f1,
       sum(f1 * (tp + fn)) / sum(tp + fn) AS weighted_f1 FROM reasons"""), ["hamming_loss", "macro_f1", "weighted_f1"]))
def l14_summary(spark, sf):
    return finalize(dn.multilabel_summary(dn.reason_metrics(_frame(spark, sf))))


@register("l14_class_metrics", rounded(with_ctes(APPLICATIONS, _DENIED, f"""
said AS (SELECT denial_reason_1 AS y, CASE WHEN {ml.id_uniform_sql("application_id", 8)} < 0.6 THEN denial_reason_1
         ELSE 1 + CAST(floor({ml.id_uniform_sql("application_id", 9)} * 9) AS INT) END AS p FROM den),
sides AS (SELECT y AS c, count(*) AS truth, 0 AS said, count(*) FILTER (y = p) AS hit FROM said GROUP BY 1
          UNION ALL SELECT p, 0, count(*), 0 FROM said GROUP BY 1),
per AS (SELECT c, sum(truth) AS truth, sum(said) AS said, sum(hit) AS hit FROM sides GROUP BY c)""", body="""
SELECT count(*) AS classes, sum(hit) / sum(truth) AS accuracy, avg(2 * hit / (truth + said)) AS macro_f1,
       sum(2 * hit / (truth + said) * truth) / sum(truth) AS weighted_f1 FROM per"""), ["accuracy", "macro_f1", "weighted_f1"]))
def l14_class_metrics(spark, sf):
    d = _denied(spark, sf)
    other = 1 + F.floor(ml.id_uniform("application_id", 9) * 9).cast("int")
    said = d.withColumn("prediction", F.when(ml.id_uniform("application_id", 8) < 0.6, F.col("denial_reason_1")).otherwise(other))
    return finalize(dn.class_metrics(said, "denial_reason_1"))


# L14 models ----------------------------------------------------------------------------
def _modelled(spark, sf):
    """Denied rows with their features, split within each primary reason."""
    d = materialize_small(_denied(spark, sf).join(model_input(spark, sf), "application_id"))
    return ml.stratified_split(d, "application_id", "denial_reason_1")


@register("l14_primary_reason_model")
def l14_primary(spark, sf):
    d = _modelled(spark, sf)
    model = dn.primary_reason_model(d.filter("is_test = 0"), ml.DEFAULT_FEATURES)
    said = dn.predict_primary_reason(model, d.filter("is_test = 1"), ml.DEFAULT_FEATURES)
    return dn.class_metrics(said, "denial_reason_1", "predicted_reason")


@register("l14_reason_model_metrics")
def l14_model_metrics(spark, sf):
    d = _modelled(spark, sf).withColumnRenamed("codes", "denial_codes")
    models = ml.denial_reason_models(d.filter("is_test = 0"), ml.DEFAULT_FEATURES)
    return dn.reason_metrics(dn.reason_frame(models, d.filter("is_test = 1"), ml.DEFAULT_FEATURES, "denial_codes"))
