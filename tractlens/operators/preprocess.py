"""Fitted preprocessing with stored state as ML pipeline stages.

Every stage learns its state in one distributed pass, keeps it as a parameter (so that
``PipelineModel.save`` / ``load`` carry it to another session), and applies it with column
expressions alone: new rows get the columns and codes of the training rows, whatever they hold.
State is small by construction: a few numbers for each scaled column, and categories up to
``maxCategories`` a column, beyond which the fit raises an error instead of leaving some out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.functions.stats import quantile_row
from tractlens.operators import features as fe

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference: inputs of the loan model and their order.
CORE = ["income", "loan_amount", "property_value", "loan_to_value_ratio", "debt_to_income_ratio", "credit_score",
        "activity_year"]
DERIVED = ["loan_to_income_ratio", "property_to_income_ratio", "risk_score"]
BANDS = {"credit_score_category": fe.LPS_CREDIT[1], "income_category": fe.LPS_INCOME[1], "loan_amount_category": fe.LPS_LOAN[1]}
BINARY = ["high_ltv", "high_dti", "low_credit"]
SCALED = ["income", "loan_amount", "property_value", "loan_to_value_ratio", "debt_to_income_ratio", "credit_score",
          "loan_to_income_ratio", "property_to_income_ratio", "risk_score"]
# ---------------------------------------------------------------------------
METHODS = ("standard", "minmax", "robust")


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns that the stage works on", TypeConverters.toListString)

    def columns(self, df: DataFrame | None = None) -> list[str]:
        names = self.getOrDefault(self.inputCols)
        return names if df is None else [c for c in names if c in df.columns]


class _State(Params):
    """What a stage has learned, as JSON text: numbers come back as the same doubles."""

    state = Param(Params._dummy(), "state", "learned state", TypeConverters.toString)

    def learned(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class LoanFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """D18 / D19 as a stage without state."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return fe.lps_features(df)


class _EncoderParams(_Columns):
    declared = Param(Params._dummy(), "declared", "JSON: column to its categories in order", TypeConverters.toString)
    maxCategories = Param(Params._dummy(), "maxCategories", "most categories of a column", TypeConverters.toInt)
    vectorCol = Param(Params._dummy(), "vectorCol", "one sparse vector instead of a column each", TypeConverters.toString)


class OneHot(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """D20 for any columns: a 0/1 column (or a slot of a sparse vector) for each category but the first.

    Categories are those declared (in their order), or else the training rows' distinct values in
    text order; nulls are no category.  All columns are counted in one pass."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, declared: str = "{}", maxCategories: int = 1000, vectorCol: str = ""):
        super().__init__()
        self._setDefault(declared="{}", maxCategories=1000, vectorCol="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "OneHotModel":
        categories = json.loads(self.getOrDefault(self.declared))
        most, names = self.getOrDefault(self.maxCategories), self.columns(df)
        open_ = [c for c in names if c not in categories]
        if open_:
            cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(open_)])
            distinct = (df.select(F.explode(cells).alias("x")).select("x.*").filter("v IS NOT NULL").distinct())
            counted = {r["i"]: r["n"] for r in distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
            if wide := [open_[i] for i, n in counted.items() if n > most]:
                raise ValueError(f"more than {most} categories: {wide}")
            found = {r["i"]: r["vs"] for r in distinct.groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect()}
            categories = categories | {c: list(found.get(i, [])) for i, c in enumerate(open_)}
        model = OneHotModel(state=json.dumps({c: categories[c] for c in names}))
        return model._set(inputCols=names, vectorCol=self.getOrDefault(self.vectorCol))


class OneHotModel(Model, _EncoderParams, _State, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._setDefault(vectorCol="", inputCols=[])
        self._set(state=state)

    def slots(self) -> list[tuple[str, str, str]]:
        """(output column, input column, category), in their fixed order."""
        return [(f"{c}_{k}", c, k) for c, ks in self.learned().items() for k in ks[1:]]

    def _transform(self, df: DataFrame) -> DataFrame:
        vector, learned = self.getOrDefault(self.vectorCol), self.learned()
        missing = df.withColumns({c: F.lit(None).cast("string") for c in learned if c not in df.columns})
        if vector:
            return self._sparse(missing, vector, {c: ks[1:] for c, ks in learned.items() if ks[1:]})
        out = missing.withColumns({name: F.coalesce(F.col(f"`{c}`").cast("string") == k, F.lit(False)).cast("int")
                                   for name, c, k in self.slots()})
        return out.drop(*learned)

    @staticmethod
    def _sparse(df: DataFrame, vector: str, labels: dict[str, list[str]]) -> DataFrame:
        """The first, null and unseen categories share an index beyond the labels, which is dropped."""
        from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler

        texts, index, hot = ({c: f"_{p}{i}" for i, c in enumerate(labels)} for p in "tih")
        out = df.withColumns({texts[c]: F.col(f"`{c}`").cast("string") for c in labels})
        for c, known in labels.items():
            out = StringIndexerModel.from_labels(known, texts[c], index[c], "keep").transform(out)
        # The encoder's sizes come from the index columns' metadata, so that its fit reads no rows.
        encoder = OneHotEncoder(inputCols=[index[c] for c in labels], outputCols=[hot[c] for c in labels], dropLast=True).fit(out.limit(0))
        out = VectorAssembler(inputCols=[hot[c] for c in labels], outputCol=vector).transform(encoder.transform(out))
        return out.drop(*texts.values(), *index.values(), *hot.values())


class _ScalerParams(_Columns):
    method = Param(Params._dummy(), "method", "standard, minmax or robust", TypeConverters.toString)
    nulls = Param(Params._dummy(), "nulls", "keep, or center: a null scales to 0", TypeConverters.toString)


class Scaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - center) / scale, from one pass over the training rows.

    ``standard`` takes mean and population deviation, ``minmax`` least value and range, ``robust``
    median and quartile distance (exact, see ``functions.stats``).  Nulls, NaN and infinities teach
    nothing; a scale of 0, or none, is 1."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, method: str = "standard", nulls: str = "keep"):
        super().__init__()
        self._setDefault(method="standard", nulls="keep")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        if self.getOrDefault(self.method) not in METHODS:
            raise ValueError(f"no scaling method {method!r}: {METHODS}")

    def _fit(self, df: DataFrame) -> "ScalerModel":
        names, method = self.columns(df), self.getOrDefault(self.method)
        x = {c: finite(c) for c in names}
        if method == "standard":
            row = df.agg(*[f(x[c]).alias(f"{p}{i}") for i, c in enumerate(names) for f, p in ((F.avg, "c"), (F.stddev_pop, "s"))])
        elif method == "minmax":
            row = df.agg(*[e.alias(f"{p}{i}") for i, c in enumerate(names)
                           for e, p in ((F.min(x[c]), "c"), (F.max(x[c]) - F.min(x[c]), "s"))])
        else:
            q = quantile_row(df, x, [0.25, 0.5, 0.75])
            row = q.select(*[e.alias(f"{p}{i}") for i, c in enumerate(names)
                             for e, p in ((F.col(f"`{c}__q1`"), "c"), (F.col(f"`{c}__q2`") - F.col(f"`{c}__q0`"), "s"))])
        got = row.first()
        state = {c: (0.0 if got[f"c{i}"] is None else got[f"c{i}"], got[f"s{i}"] or 1.0) for i, c in enumerate(names)}
        return ScalerModel(state=json.dumps(state))._set(inputCols=names, method=method, nulls=self.getOrDefault(self.nulls))


class ScalerModel(Model, _ScalerParams, _State, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._setDefault(inputCols=[], method="standard", nulls="keep")
        self._set(state=state)

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (finite(c) - F.lit(float(center))) / F.lit(float(scale)) for c, (center, scale) in self.learned().items() if c in df.columns}
        if self.getOrDefault(self.nulls) == "center":
            scaled = {c: F.coalesce(x, F.lit(0.0)) for c, x in scaled.items()}
        return df.withColumns(scaled)


def finite(name: str):
    """The column as a double; NaN and infinities are null."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(F.abs(x) < float("inf"), x)


class _OrderParams(Params):
    keys = Param(Params._dummy(), "keys", "columns that pass through", TypeConverters.toListString)
    wanted = Param(Params._dummy(), "wanted", "feature columns, or the start of their names before *", TypeConverters.toListString)


class ColumnOrder(Estimator, _OrderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Freezes the feature columns of the training rows in the order of ``wanted``."""

    @keyword_only
    def __init__(self, *, keys: Sequence[str] = (), wanted: Sequence[str] = ()):
        super().__init__()
        self._setDefault(keys=[], wanted=[])
        self._set(keys=list(keys), wanted=list(wanted))

    def _fit(self, df: DataFrame) -> "ColumnOrderModel":
        names = [c for w in self.getOrDefault(self.wanted) for c in df.columns
                 if (c == w if not w.endswith("*") else c.startswith(w[:-1]))]
        return ColumnOrderModel(state=json.dumps({"features": names}))._set(keys=self.getOrDefault(self.keys))


class ColumnOrderModel(Model, _OrderParams, _State, DefaultParamsReadable, DefaultParamsWritable):
    """Selects the frozen columns; those that new rows lack are 0."""

    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._setDefault(keys=[])
        self._set(state=state)

    def _transform(self, df: DataFrame) -> DataFrame:
        keys = [F.col(f"`{k}`") for k in self.getOrDefault(self.keys) if k in df.columns]
        return df.select(*keys, *[(F.col(f"`{c}`") if c in df.columns else F.lit(0)).alias(c) for c in self.learned()["features"]])


def preprocessor(method: str = "standard", keys: Sequence[str] = ("application_id",)) -> Pipeline:
    """Create features, encode their bands, scale, order.  ``fit`` it on training rows; the
    fitted pipeline's ``save`` and ``PipelineModel.load`` carry it to where new rows are."""
    return Pipeline(stages=[
        LoanFeatures(),
        OneHot(inputCols=list(BANDS), declared=json.dumps(BANDS)),
        Scaler(inputCols=SCALED, method=method),
        ColumnOrder(keys=list(keys), wanted=[*CORE, *DERIVED, *[f"{c}_*" for c in BANDS], *BINARY]),
    ])


def transform_new_data(df: DataFrame, path: str) -> DataFrame:
    """New rows through a saved preprocessor."""
    return PipelineModel.load(path).transform(df)
