"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

*Features.*  The text is lower-cased, runs of characters that are no letters or digits
become one space, and a space is put at both ends; a feature is the presence of a
character n-gram (``sizes``) hashed to one of ``2**bits`` cells.

*Training* reads labelled rows only where ``crc32(id as text) % 3 != 1``, at most
``per_class`` rows of each label, those with the smallest hash of their id (a bounded
sample; its size is a parameter, and also bounds what the driver sees).  Document
frequencies per class give the log-count ratio ``r`` of every cell (smoothing
``alpha``); of the cells that speak for label 1 (r > 0), the ``n_features`` with the largest
likelihood-ratio statistic stay, so that a long text doesn't talk a toxic one down.
A logistic regression with L2 penalty is fitted on presence * r, with equal class
weights.  Its intercept is then moved so that the decision score ``decide_at`` lies midway
between the sample's highest clean scores (99.9 %) and lowest toxic ones (2 %).

*Scores* are ``1 / (1 + exp(-(intercept + sum of weights of the cells present)))``.
No label, language, source or id enters a score.

Edge cases: null and empty texts score as texts without features; rows with a null
id or label are never trained on; an id labelled several times counts with its
largest label; with one label only, every score is the smoothed share; repeated ids
give one row each; texts of any length are scored whole; an empty table gives an empty
table.  Only the named columns are read, and ``keep_rows`` carries the row in one struct, so
columns with clashing names do no harm.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import in_batches, release, schema_of, text_column, whole_rows

_NO_WORD = re.compile(r"[\W_]+")
#: Characters that one step looks at; longer texts are looked at in overlapping pieces.
PIECE = 1 << 20


@dataclass(frozen=True)
class Params:
    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    per_class: int = 4000
    n_features: int = 2048
    alpha: float = 1.0
    l2: float = 1.0
    steps: int = 1000
    decide_at: float = 0.7


@dataclass
class Model:
    params: Params
    weights: np.ndarray  # by cell; 0 where a cell isn't used
    intercept: float


def cells(text: str | None, sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct cells of a text's n-grams; with ``wanted``, those where it is true."""
    plain = " " + _NO_WORD.sub(" ", (text or "").lower()).strip() + " "
    code = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(code), PIECE):
        piece = code[a : a + PIECE + max(sizes) - 1]
        h = np.zeros(len(piece), np.uint64)
        for n in range(1, max(sizes) + 1):
            if len(piece) < n:
                break
            h = h[: len(piece) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + piece[n - 1 :]
            if n in sizes:
                cell = (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)
                found.append(cell if wanted is None else cell[wanted[cell]])
    return np.unique(np.concatenate(found))


def held_out(id_col: str) -> Column:
    """Rows that are never trained on."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def training_sample(docs: DataFrame, labels: DataFrame, p: Params, id_col: str, text_col: str,
                    label_col: str) -> DataFrame:
    """At most ``per_class`` (text, label) rows of each label (more where an id is repeated)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.max(label_col).cast("int").alias("label")).filter(~held_out(id_col))
    known = known.withColumn("order", F.xxhash64(id_col))
    # Labels of documents that are not in the input teach nothing.
    known = known.join(docs.select(F.col(id_col)).distinct(), id_col, "left_semi")
    chosen = [known.filter(F.col("label") == x).orderBy("order", id_col).limit(p.per_class) for x in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(id_col, "label")
    # At most 2 * per_class ids: a proven bound for the broadcast.
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return rows.join(F.broadcast(ids), id_col).select("text", "label")


def _frequencies(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Per task and label: rows, and document frequencies of all cells."""
    release()
    n, df = np.zeros(2, np.int64), np.zeros((2, 1 << p.bits), np.int32)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            df[label][cells(text, p.sizes, p.bits)] += 1
            n[label] += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([0, 1]), pa.array(n), pa.array([df[0].tobytes(), df[1].tobytes()], pa.binary())],
        names=["label", "n", "df"])


def _present(batches: Iterator[pa.RecordBatch], p: Params, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [cells(t, p.sizes, p.bits, wanted).astype(np.int32).tolist() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(got, pa.list_(pa.int32()))], names=["label", "cells"])


def log_count_ratios(df: np.ndarray, alpha: float) -> np.ndarray:
    p, q = df[1] + alpha, df[0] + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def informative(df: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The k cells whose presence tells the labels apart best (likelihood-ratio statistic)."""
    both, out = df.sum(0), np.zeros(df.shape[1])
    for x in (0, 1):
        for seen, total in ((df[x], both), (n[x] - df[x], n.sum() - both)):
            expected = total * (n[x] / n.sum())
            out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)
    keep = np.zeros(len(out), bool)
    keep[np.argsort(-out, kind="stable")[:k]] = True
    return keep & (both > 1)


def fit_logistic(indices: np.ndarray, offsets: np.ndarray, labels: np.ndarray, scale: np.ndarray, l2: float,
                 steps: int) -> tuple[np.ndarray, float]:
    """Weights of scaled binary features and the intercept, by accelerated gradient descent.

    Classes weigh the same.  ``indices[offsets[i]:offsets[i+1]]`` are row i's features.
    """
    n, k = len(labels), len(scale)
    row = np.repeat(np.arange(n), np.diff(offsets))
    value = scale[indices]
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
    # Lipschitz bound of the loss's gradient: a quarter of the largest squared row norm.
    bound = 0.25 * (np.bincount(row, value**2, n).max(initial=0.0) + 1) + l2 / n
    w, b, v, c = np.zeros(k), 0.0, np.zeros(k), 0.0
    for step in range(steps):
        z = np.bincount(row, v[indices] * value, n) + c
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        nw = v - (np.bincount(indices, g[row] * value, k) + l2 / n * v) / bound
        nb = c - g.sum() / bound
        m = step / (step + 3)
        v, c, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    sample = training_sample(docs, labels, p, id_col, text_col, label_col)
    sample = sample.repartition(8)  # the sample is bounded, and so is what 8 tasks return
    n, df = np.zeros(2, np.int64), np.zeros((2, 1 << p.bits), np.int64)
    for r in sample.transform(in_batches).mapInArrow(lambda it: _frequencies(it, p), "label long, n long, df binary").toLocalIterator():
        n[r["label"]] += r["n"]
        df[r["label"]] += np.frombuffer(r["df"], np.int32)
    weights = np.zeros(1 << p.bits)
    if not n.all():
        return Model(p, weights, math.log((n[1] + 1) / (n[0] + 1)))
    ratios = log_count_ratios(df, p.alpha)
    wanted = informative(np.where(ratios > 0, df, 0), n, p.n_features)
    rows = sample.transform(in_batches).mapInArrow(lambda it: _present(it, p, wanted), "label int, cells array<int>").toPandas()
    number = np.cumsum(wanted) - 1
    offsets = np.concatenate([[0], np.cumsum(rows["cells"].map(len).to_numpy(np.int64))])
    flat = np.concatenate([np.asarray(c, np.int64) for c in rows["cells"]])
    w, _ = fit_logistic(number[flat], offsets, rows["label"].to_numpy(np.int64), ratios[wanted], p.l2, p.steps)
    weights[wanted] = w * ratios[wanted]
    label = rows["label"].to_numpy()
    z = np.bincount(np.repeat(np.arange(len(label)), np.diff(offsets)), weights[flat], len(label))
    clean, toxic = np.quantile(z[label == 0], 0.999), np.quantile(z[label == 1], 0.02)
    return Model(p, weights, math.log(p.decide_at / (1 - p.decide_at)) - (clean + max(clean, toxic)) / 2)


@functools.lru_cache(maxsize=1)
def _loaded(weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    w = np.frombuffer(weights, np.float32)
    return w, w != 0


def _score(batches: Iterator[pa.RecordBatch], p: Params, weights: bytes, intercept: float,
           texts: Callable) -> Iterator[pa.RecordBatch]:
    release()
    w, wanted = _loaded(weights)
    for batch in batches:
        z = [intercept + float(w[cells(t, p.sizes, p.bits, wanted)].sum(dtype=np.float64)) for t in texts(batch).to_pylist()]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])


def with_score(rows: DataFrame, text: str | tuple[str, str], model: Model) -> DataFrame:
    """``rows`` (without a column named score) with ``score``."""
    p, weights, intercept = model.params, model.weights.astype(np.float32).tobytes(), model.intercept
    texts = text_column(rows, text)
    return rows.transform(in_batches).mapInArrow(lambda it: _score(it, p, weights, intercept, texts), f"{schema_of(rows)}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """``(id, held_out, score, predicted)``, one row per row of ``docs``."""
    model = train(docs, labels, params, id_col, text_col, label_col)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return with_score(d, "text", model).select(
        F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_rows(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    model = train(docs, labels, params, id_col, text_col, label_col)
    return with_score(whole_rows(docs), ("row", text_col), model).filter(F.col("score") < threshold).select("row.*")
