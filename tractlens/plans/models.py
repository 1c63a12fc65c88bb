"""Model jobs as registered queries.

Model-backed queries have no SQL oracle (the driver records a rows-only
check); the rule-based and counting ones do.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.functions import parse
from tractlens.functions.frames import pooled
from tractlens.functions.stats import materialize_small
from tractlens.operators import forecast as fc
from tractlens.operators import ml
from tractlens.operators import rules as R
from tractlens.operators import temporal as tm
from tractlens.operators import tuning as tn
from tractlens.operators.splits import stratified_parts
from tractlens.oracle.views import APPLICATIONS, rounded, with_ctes
from tractlens.plans.registry import finalize, register
from tractlens.plans.temporal import panel, temporal
from tractlens.plans.validation import MODEL_INPUT_SQL, model_input
from tractlens.session import ensure_checkpoint_dir
from tractlens.sources.sinks import load_pipeline_model, save_model
from tractlens.sources.tables import applications

FEATURES = ml.DEFAULT_FEATURES


def labelled(spark, sf):
    """Model rows: clear approve / deny outcomes only (C5), with the split flag (L1)."""
    a = model_input(spark, sf).withColumn("label", parse.model_target(F.col("action_taken")).cast("double"))
    # Written once: the split, the class counts, training and scoring all read it.
    return ml.stratified_split(materialize_small(a.filter(F.col("label") >= 0)), "application_id")


#: The stated budget of the random search (L13) and of the boosted model whose errors L17 counts.
RANDOM_SEARCH = tn.Budget(points=4, shares=(0.1, 0.3), eta=2)


def _fit(spark, sf, model_types=("logistic_regression", "random_forest", "gbt"), budget=tn.WHOLE):
    d = labelled(spark, sf)
    train = ml.class_weights(d.filter(F.col("is_test") == 0), "label")  # balanced by the training rows alone
    search = lambda name: tn.halving_search(train, FEATURES, name, ml.OUTCOME_GRIDS[name], "application_id", weight="weight",
                                            budget=budget)
    # The families' small jobs run side by side.
    return d, dict(zip(model_types, pooled([lambda n=n: search(n) for n in model_types])))


_LABELLED_SQL = f"""
labelled AS (
SELECT application_id, CAST(CASE WHEN action_taken IN (1, 2, 6, 8) THEN 1 ELSE 0 END AS DOUBLE) AS label,
       {ml.id_uniform_sql("application_id", ml.SEED + 1)} AS u,
       {ml.id_order_sql("application_id", ml.SEED)} AS x
FROM model_input WHERE action_taken IN (1, 2, 3, 6, 7, 8)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x, application_id) AS k, count(*) OVER (PARTITION BY label) AS size
           FROM labelled),
split AS (SELECT *, CAST(floor(size * CAST({ml.TEST_FRACTION} AS DOUBLE) + 0.5) AS BIGINT) AS n_test FROM ranked)"""


@register("l1_stratified_split", with_ctes(APPLICATIONS, MODEL_INPUT_SQL, _LABELLED_SQL, body="""
SELECT label, CAST(k <= n_test AS INT) AS is_test, count(*) AS rows, CAST(sum(application_id) AS BIGINT) AS ids FROM split GROUP BY 1, 2"""))
def l1(spark, sf):
    return labelled(spark, sf).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("rows"), F.sum("application_id").alias("ids"))


@register("l1_three_way_split", with_ctes(APPLICATIONS, MODEL_INPUT_SQL, _LABELLED_SQL, body="""
SELECT label, CASE WHEN k <= n_test THEN 'test' WHEN k <= n_test + floor((size - n_test) * CAST(0.1 AS DOUBLE) + 0.5) THEN 'validation' ELSE 'train' END AS part,
       count(*) AS rows, CAST(sum(application_id) AS BIGINT) AS ids FROM split GROUP BY 1, 2"""))
def l1_three_way(spark, sf):
    a = model_input(spark, sf).withColumn("label", parse.model_target(F.col("action_taken")).cast("double")).filter("label >= 0")
    parts = stratified_parts(a, "application_id", "label", ml.TEST_FRACTION, 0.1, ml.SEED)
    return parts.groupBy("label", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("application_id").alias("ids"))


@register("l13_class_weights", rounded(with_ctes(APPLICATIONS, MODEL_INPUT_SQL, body="""
SELECT label, n / (k * n_c) AS weight FROM
  (SELECT CAST(CASE WHEN action_taken IN (1, 2, 6, 8) THEN 1 ELSE 0 END AS DOUBLE) AS label, count(*) AS n_c
   FROM model_input WHERE action_taken IN (1, 2, 3, 6, 7, 8) GROUP BY 1),
  (SELECT count(*) AS n, count(DISTINCT CASE WHEN action_taken IN (1, 2, 6, 8) THEN 1 ELSE 0 END) AS k
   FROM model_input WHERE action_taken IN (1, 2, 3, 6, 7, 8))"""), ["weight"]))
def l13(spark, sf):
    a = model_input(spark, sf).withColumn("label", parse.model_target(F.col("action_taken")).cast("double"))
    return finalize(ml.class_weights(a.filter(F.col("label") >= 0), "label").select("label", "weight").distinct())


@register("l15_undersample", with_ctes(APPLICATIONS, MODEL_INPUT_SQL, _LABELLED_SQL, """
n AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1)""", body="""
SELECT label, count(*) AS rows FROM labelled JOIN n USING (label)
WHERE u < least(1.0, (SELECT min(n) FROM n) / n.n) GROUP BY 1"""))
def l15(spark, sf):
    return ml.undersample(labelled(spark, sf), "label").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def _forest(spark, sf):
    """The forest that scores, importances and fairness are read from: the grid's first point, on balanced training rows."""
    d = labelled(spark, sf)
    config = {"algorithm": "random_forest", "params": {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 1}}
    return d, tn.train_configured(d.filter(F.col("is_test") == 0), FEATURES, "application_id", config).model


@register("l12_outcome_models")
def l12(spark, sf):
    """The reference's grid search: all points of its grids on all training rows, by five folds."""
    d, models = _fit(spark, sf)
    test = ml._numeric(d.filter(F.col("is_test") == 1), FEATURES)
    met = pooled([lambda n=n, m=m: ml.classification_metrics(m.model.transform(test), "label", n) for n, m in models.items()])
    return ml.model_summary(reduce(DataFrame.unionByName, met))


@register("l13_random_search")
def l13_search(spark, sf):
    _, found = _fit(spark, sf, ("gbt",), RANDOM_SEARCH)
    return found["gbt"].table(spark, "gbt")


@register("l16_batch_scoring")
def l16(spark, sf):
    d, model = _forest(spark, sf)
    return ml.batch_score(model, d, FEATURES)


@register("l17_confusion_matrix")
def l17(spark, sf):
    d, models = _fit(spark, sf, ("gbt",), RANDOM_SEARCH)
    test = ml._numeric(d.filter(F.col("is_test") == 1), FEATURES)
    return ml.confusion_matrix(models["gbt"].model.transform(test), "label")


@register("i9_feature_importance")
def i9(spark, sf):
    return ml.feature_importance(_forest(spark, sf)[1], FEATURES)


@register("f18_fairness_table")
def f18(spark, sf):
    d, model = _forest(spark, sf)
    test = d.filter(F.col("is_test") == 1).join(
        applications(spark, sf).select("application_id", "applicant_race", "applicant_sex"), "application_id")
    scored = ml.batch_score(model, test, FEATURES)
    return ml.fairness_table(scored, ["applicant_race", "applicant_sex"])


def _denied(spark, sf):
    a = applications(spark, sf)
    codes = F.array_compact(F.array(F.col("denial_reason_1"), F.col("denial_reason_2")))
    return (a.filter(F.col("action_taken") == 3).withColumn("denial_codes", codes)
             .select("application_id", "applicant_race", "applicant_sex", "denial_codes"))


@register("l14_denial_reason_models")
def l14(spark, sf):
    feats = model_input(spark, sf)
    denied = materialize_small(_denied(spark, sf).join(feats, "application_id"))
    models = ml.denial_reason_models(denied, FEATURES)
    return ml.predict_denial_reasons(models, denied, FEATURES).select("application_id", "denial_explanation")


@register("f19_denial_patterns", rounded(with_ctes(APPLICATIONS, """
den AS (SELECT application_id, applicant_race, applicant_sex,
               list_distinct(list_filter([denial_reason_1, denial_reason_2], lambda x: x IS NOT NULL)) AS codes
        FROM applications WHERE action_taken = 3),
lng AS (SELECT 'applicant_race' AS "group", CAST(applicant_race AS VARCHAR) AS value, codes FROM den
        UNION ALL SELECT 'applicant_sex', CAST(applicant_sex AS VARCHAR), codes FROM den),
tot AS (SELECT "group", value, count(*) AS group_denials FROM lng GROUP BY 1, 2),
rs AS (SELECT "group", value, code, count(*) AS count FROM (SELECT "group", value, unnest(codes) AS code FROM lng)
       GROUP BY 1, 2, 3)""", body=f"""
SELECT r."group", r.value, r.code, r.count, t.group_denials,
       CASE {' '.join(f"WHEN r.code = {k} THEN '{v}'" for k, v in R.DENIAL_LABELS.items())} ELSE 'Unknown reason' END AS reason,
       r.count / t.group_denials * 100 AS pct_of_group_denials
FROM rs r JOIN tot t ON r."group" = t."group" AND r.value = t.value"""), ["pct_of_group_denials"]))
def f19(spark, sf):
    return finalize(ml.denial_patterns(_denied(spark, sf), ["applicant_race", "applicant_sex"]))


@register("f20_denial_reason_frequency", rounded(with_ctes(APPLICATIONS, body=f"""
SELECT code, CASE {' '.join(f"WHEN code = {k} THEN '{v}'" for k, v in R.DENIAL_LABELS.items())} ELSE 'Unknown reason' END AS reason,
       count(*) AS count, count(*) / sum(count(*)) OVER () * 100 AS pct_of_denials
FROM (SELECT unnest(list_distinct(list_filter([denial_reason_1, denial_reason_2], lambda x: x IS NOT NULL))) AS code
      FROM applications WHERE action_taken = 3) GROUP BY code"""), ["pct_of_denials"]))
def f20(spark, sf):
    d = _denied(spark, sf).select(F.explode(F.array_distinct("denial_codes")).alias("code"))
    g = d.groupBy("code").agg(F.count(F.lit(1)).alias("count"))
    tot = g.agg(F.sum("count").alias("_t"))
    return finalize(g.crossJoin(F.broadcast(tot)).select(
        "code", R.denial_label(F.col("code")).alias("reason"), "count",
        (F.col("count") / F.col("_t") * 100).alias("pct_of_denials")))


_K11_SQL = with_ctes(APPLICATIONS, MODEL_INPUT_SQL, """
k0 AS (SELECT application_id, coalesce(debt_to_income_ratio, 0.0) AS d, coalesce(loan_to_value_ratio, 0.0) AS l,
              coalesce(CAST(credit_score AS DOUBLE), 0.0) AS s, coalesce(income * 1000, 0.0) AS inc,
              coalesce(loan_amount, 0.0) AS la, coalesce(property_value, 0.0) AS pv FROM model_input)""", f"""
k1 AS (SELECT application_id, d, l, s, list_filter([
  CASE WHEN d > 50 THEN '{R.R_DTI_50}' WHEN d > 43 THEN '{R.R_DTI}' END,
  CASE WHEN s < 620 THEN '{R.R_CREDIT}' WHEN s < 680 AND d > 40 THEN '{R.R_CREDIT_MARGINAL}' END,
  CASE WHEN l > 95 THEN '{R.R_LTV}' WHEN pv > 0 AND la > pv THEN '{R.R_LOAN_GT_VALUE}' END,
  CASE WHEN l > 90 AND d > 36 THEN '{R.R_CASH}' WHEN l > 97 THEN '{R.R_CASH}' END,
  CASE WHEN inc < 30000 THEN '{R.R_INCOME_LOW}' WHEN inc > 0 AND la > 0 AND la / inc > 5 THEN '{R.R_INCOME_LTI}' END
  ], lambda x: x IS NOT NULL) AS r FROM k0)""", f"""
k2 AS (SELECT application_id, CASE
  WHEN len(r) = 0 AND (CAST(d > 36 AS INT) + CAST(l > 80 AS INT) + CAST(s < 700 AS INT)) >= 2 THEN ['{R.R_MULTI}']
  WHEN len(r) = 0 THEN [CASE WHEN d > 28 THEN '{R.R_DTI_CONSERVATIVE}' WHEN l > 85 THEN '{R.R_CASH}'
                             WHEN s < 740 THEN '{R.R_CREDIT}' ELSE '{R.R_OTHER}' END]
  ELSE r END AS r FROM k1)""", body="""
SELECT application_id, array_to_string(r[1:3], ' | ') AS denial_reasons, CAST(len(r[1:3]) AS INT) AS n_reasons FROM k2""")


@register("k11_rule_denial_reasons", _K11_SQL)
def k11(spark, sf):
    m = model_input(spark, sf)
    r = R.rule_denial_reasons(F.col("debt_to_income_ratio"), F.col("loan_to_value_ratio"), F.col("credit_score"),
                              F.col("income") * 1000, F.col("loan_amount"), F.col("property_value"))
    return m.select("application_id", F.concat_ws(" | ", r).alias("denial_reasons"), F.size(r).cast("int").alias("n_reasons"))


def _panel(spark, sf):
    """The scored panel, written once: its plan is long, and fits, trends and horizons all read it."""
    return materialize_small(temporal(spark, sf))


def _temporal_fit(spark, sf, latest_only=False):
    t = _panel(spark, sf)
    feats = tm.TEMPORAL_FEATURES[1:] + ["year_normalized", "total_applications"] + [
        c for c in t.columns if c.endswith(("_lag1", "_yoy_change", "_yoy_pct_change", "_ma2"))]
    # One model set per year of the panel; forecasts use that of the latest year only.
    recent = sorted(r[0] for r in t.select("year").distinct().collect())
    years = recent[-1:] if latest_only else recent
    metrics, best = ml.temporal_models(t, feats, years=years)
    return t, feats, metrics, best


@register("l4_temporal_models")
def l4(spark, sf):
    return _temporal_fit(spark, sf)[2]


def predictions(spark, sf, ahead=(1, 2)):
    # Forecasts use the model of the most recent training year only.
    t, feats, _, best = _temporal_fit(spark, sf, latest_only=True)
    recent = max(best)
    trends = tm.tract_trends(t)
    future = tm.temporal_progression(t, trends, [recent + h for h in ahead])
    return ml.predict_future(best[recent][1], future, feats)


@register("l10_temporal_predictions")
def l10(spark, sf):
    return predictions(spark, sf)


@register("f13_prediction_year_summary")
def f13(spark, sf):
    return tm.prediction_year_summary(predictions(spark, sf))


@register("f16_consistent_high_performers")
def f16(spark, sf):
    return tm.consistent_high_performers(predictions(spark, sf))


@register("i7_top_predicted_per_year")
def i7(spark, sf):
    return tm.top_per_year(predictions(spark, sf))


@register("f17_forecast_level_pivot")
def f17(spark, sf):
    p = predictions(spark, sf).withColumn("predicted_opportunity_level",
                                          tm.forecast_level(F.col("predicted_opportunity_score")))
    return tm.level_pivot(p)


@register("i8_forecast_change_extremes")
def i8(spark, sf):
    return tm.forecast_change_extremes(predictions(spark, sf))


@register("h12_history_transition")
def h12(spark, sf):
    return tm.history_transition(_panel(spark, sf), predictions(spark, sf))


@register("j2_history_prediction_timeline")
def j2(spark, sf):
    return tm.historical_predicted_timeline(_panel(spark, sf), predictions(spark, sf))


@register("l5_expanding_window_cv")
def l5(spark, sf):
    """The winner over time, saved and read back before its fit on all years is judged."""
    p = panel(spark, sf)
    names = fc.input_names(p)
    found = tn.select_over_time(fc.forecast_inputs(p, names), names)
    path = f"{ensure_checkpoint_dir(spark)}/forecaster-{uuid.uuid4().hex}"
    save_model(found.model, path)
    load_pipeline_model(path)
    return found.table
