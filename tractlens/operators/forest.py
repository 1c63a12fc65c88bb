"""Random forests over training frames that are too large for MLlib's trainer.

MLlib keeps a bootstrap count of four bytes for every row and tree, walks boxed nodes, and at some
ten million rows and a hundred trees neither fits the memory nor the time.  Here a row is one byte
for each feature and two for its labels, a task holds a block of rows and the counts of one level,
and bootstrap counts come again from a block's key whenever they are needed.

The forest is the same kind of forest: up to ``BINS`` bins a feature (by quantiles of all rows),
Poisson bootstrap, features drawn anew for each node, Gini gain of class-weighted counts, least
rows on both sides, equal leaves of one parent merged.  It is handed back as MLlib's own model.
Only its random numbers differ from MLlib's, and they don't depend on the order of tasks.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.functions.stats import materialize_small
from tractlens.session import ensure_checkpoint_dir

BINS = 32
#: Rows of a stored piece, and of the block that a task works on at once.
PIECE, BLOCK = 4096, 32768
#: Nodes are numbered as in a full binary tree.
MOST_DEPTH = 12
#: Training frames of more rows than this are too large for MLlib's trainer.
LARGE_ROWS = 200_000
#: Points of the quantile sketch that bins are cut from.
POINTS, ACCURACY = 1024, 10_000
#: Bootstrap counts by a uniform 16-bit number: Poisson of mean 1.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16), "right").astype(np.uint8)


def takes(est, rows: int) -> bool:
    """Whether ``est`` (MLlib's classifier) on so many rows is a forest for this module."""
    plain = (est.getFeatureSubsetStrategy() in ("auto", "sqrt") and est.getSubsamplingRate() == 1.0 and est.getBootstrap() and est.getImpurity() == "gini"
             and est.getMaxBins() == BINS and est.getMinInfoGain() == 0.0 and est.getMinWeightFractionPerNode() == 0.0)
    return rows > LARGE_ROWS and plain and est.getNumTrees() > 1 and est.getMaxDepth() <= MOST_DEPTH


def balanced(sizes: Mapping[int, int]) -> dict[int, float]:
    """Class weights n / (k * n_class) of the classes that occur."""
    found = {y: n for y, n in sizes.items() if n}
    return {y: sum(found.values()) / (len(found) * n) for y, n in found.items()}


@dataclass(frozen=True)
class Forest:
    trees: int
    depth: int
    least_rows: int = 1
    seed: int = 42


@dataclass
class Binned:
    """Rows as pieces ``(key, bins, labels)``: bytes of bins row by row, and 16 label bits a row."""

    pieces: DataFrame
    #: Upper ends of each feature's bins but the last.
    cuts: list[np.ndarray]
    imputer: PipelineModel
    features: list[str]


def bin_cuts(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Thresholds of each column: between its values where they are few, else at quantiles of all rows."""
    at = [i / POINTS for i in range(POINTS + 1)]
    row = df.agg(*[F.percentile_approx(c, at, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    out = []
    for points in row:
        v = np.unique(np.array(points or [], float))
        if len(v) <= BINS:
            out.append((v[1:] + v[:-1]) / 2)
        else:
            out.append(np.unique([points[i * POINTS // BINS] for i in range(1, BINS)]))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def cut_off(rows: int) -> pa.RecordBatch:
        nonlocal made, held, size
        bins, labels = (np.concatenate(x) for x in zip(*held))
        held, size = [(bins[rows:], labels[rows:])], len(bins) - rows
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([bins[:rows].tobytes()]), pa.array([labels[:rows].tobytes()])],
                                          names=["key", "bins", "labels"])

    for batch in batches:
        bins = np.empty((batch.num_rows, len(cuts)), np.uint8)
        for i, c in enumerate(cuts):
            bins[:, i] = np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False), "left")
        held.append((bins, batch.column(len(cuts)).to_numpy(zero_copy_only=False).astype(np.uint16)))
        size += batch.num_rows
        while size >= PIECE:
            yield cut_off(PIECE)
    if size:
        yield cut_off(size)


def binned(data: DataFrame, features: Sequence[str], labels: Column) -> Binned:
    """``data`` (written once, double features) with gaps filled by medians; ``labels`` has a bit for each target."""
    from tractlens.operators.ml import _imputed

    conf, key = data.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":  # a batch of pieces is some megabytes then
        conf.set(key, "1000")
    imputer = Pipeline(stages=_imputed(features)).fit(data)
    filled = imputer.stages[0].transform(data).select(*[F.col(f"_imp_{c}").alias(f"x{i}") for i, c in enumerate(features)], labels.cast("int").alias("labels"))
    cuts = bin_cuts(filled, [f"x{i}" for i in range(len(features))])
    pieces = materialize_small(filled.mapInArrow(lambda it: _pieces(it, cuts), "key long, bins binary, labels binary"))
    # A task for each core: each of them sends the counts of a level once.
    return Binned(materialize_small(pieces.repartition(data.sparkSession.sparkContext.defaultParallelism)), cuts, imputer, list(features))


# Growing ------------------------------------------------------------------------------
@dataclass
class _Level:
    """What tasks need of the trees so far: ``code`` of each node (feature and bin of its split), the
    nodes to split and the features drawn for them."""

    number: int
    code: np.ndarray
    place: np.ndarray
    drawn: list[np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    held, size = [], 0

    def joined() -> tuple[list, np.ndarray, np.ndarray]:
        keys, bins, labels = zip(*held)
        return [(k, len(y)) for k, y in zip(keys, labels)], np.concatenate(bins), np.concatenate(labels)

    for batch in batches:
        for k, b, y in zip(*(c.to_pylist() for c in batch.columns)):
            held.append((k, np.frombuffer(b, np.uint8), np.frombuffer(y, np.uint16)))
            size += len(b) // width
            if size >= BLOCK:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _bootstrap(keys: list, tree: int, seed: int) -> np.ndarray:
    return np.concatenate([_POISSON[np.random.Generator(np.random.SFC64([seed, tree, k])).integers(0, 1 << 16, n, np.uint16)] for k, n in keys])


def _count(batches: Iterator[pa.RecordBatch], level: _Level, width: int, bit: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Bootstrap rows of each (node to split, drawn feature, bin, class), a tree at a time."""
    trees = [t for t, d in enumerate(level.drawn) if len(d)]
    counts = {t: np.zeros(level.drawn[t].size * BINS * 2, np.int64) for t in trees}
    for keys, flat, labels in _blocks(batches, width):
        y = (labels >> bit & 1).astype(np.intp)
        for t in trees:
            times = _bootstrap(keys, t, seed)
            rows = np.flatnonzero(times)
            base, node = rows * width, np.zeros(len(rows), np.intp)
            for _ in range(level.number):
                code = level.code[t].take(node)
                node += node
                node += 1
                node += flat.take(base + (code >> 8)) > (code & 255)
            place = level.place[t].take(node)
            if place.min(initial=0) < 0:  # rows that ended in a leaf
                stays = np.flatnonzero(place >= 0)
                rows, base, place = rows[stays], base[stays], place[stays]
            weight, side = times[rows].astype(float), y[rows]
            m = level.drawn[t].shape[1]
            drawn = level.drawn[t].ravel()
            place *= m
            for j in range(m):
                at = place + j
                bins = flat.take(base + drawn.take(at))
                at *= BINS
                at += bins
                at += at
                at += side
                counts[t] += np.bincount(at, weight, len(counts[t])).astype(np.int64)
    for t in trees:
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([counts[t].tobytes()])], names=["tree", "counts"])


def _gini(n: np.ndarray) -> np.ndarray:
    total = n.sum(-1)
    return 1 - ((n / np.where(total > 0, total, 1)[..., None]) ** 2).sum(-1)


def best_splits(counts: np.ndarray, weights: np.ndarray, least_rows: int) -> tuple[np.ndarray, ...]:
    """Of counts (node, drawn feature, bin, class): the drawn feature and the last bin of the left side
    with the most gain, that gain (0 or less: a leaf), and both sides' counts."""
    left = counts.cumsum(2)[:, :, :-1]
    whole = counts.sum(2)[:, :1, None]
    right = whole - left
    share = (left * weights).sum(-1) / np.maximum((whole * weights).sum(-1), 1e-300)
    gain = _gini(whole * weights) - share * _gini(left * weights) - (1 - share) * _gini(right * weights)
    fits = (left.sum(-1) >= max(1, least_rows)) & (right.sum(-1) >= max(1, least_rows))
    gain = np.where(fits, gain, -np.inf).reshape(len(counts), -1)
    best = gain.argmax(1)
    node, (j, b) = np.arange(len(counts)), np.divmod(best, counts.shape[2] - 1)
    return j, b, gain[node, best], left[node, j, b], right[node, j, b]


def _split(batches: Iterator[pa.RecordBatch], drawn: list[np.ndarray], weights: np.ndarray, least_rows: int) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for t, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            n = np.frombuffer(c.as_buffer(), np.int64)
            sums[t] = sums[t] + n if t in sums else n
    for t, n in sums.items():
        j, b, gain, left, right = best_splits(n.reshape(*drawn[t].shape, BINS, 2), weights, least_rows)
        table = np.column_stack([drawn[t][np.arange(len(j)), j], b, gain, left, right])
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([table.astype(float).tobytes()])], names=["tree", "splits"])


def grow(data: Binned, bit: int, weights: np.ndarray, forest: Forest) -> list[dict[int, tuple]]:
    """Nodes of each tree, by number (children of i: 2i + 1, 2i + 2): ``(feature, bin, gain, counts)``; a
    leaf's feature is -1.  One job for each level counts all trees' rows and another stage splits."""
    width, T = len(data.features), forest.trees
    drawn_of = math.ceil(math.sqrt(width))
    code = np.full((T, (1 << forest.depth + 1) - 1), 255, np.intp)  # every bin goes left
    todo = [[0] for _ in range(T)]
    trees: list[dict[int, tuple]] = [{} for _ in range(T)]
    for number in range(forest.depth):
        place = np.full(code.shape, -1, np.intp)
        drawn = []
        for t in range(T):
            place[t, todo[t]] = np.arange(len(todo[t]))
            of_level = np.random.Generator(np.random.SFC64([forest.seed, t, number, 1])).random((1 << number, width)).argsort(1)[:, :drawn_of]
            drawn.append(np.sort(of_level, 1).astype(np.intp)[np.array(todo[t], np.intp) - ((1 << number) - 1)])
        if not any(todo):
            break
        level = _Level(number, code, place, drawn)
        counted = data.pieces.mapInArrow(lambda it, level=level: _count(it, level, width, bit, forest.seed), "tree long, counts binary")
        split = counted.repartition(min(T, data.pieces.rdd.getNumPartitions()), "tree").mapInArrow(
            lambda it, drawn=drawn: _split(it, drawn, weights, forest.least_rows), "tree long, splits binary")
        for r in split.collect():
            t, found, after = r["tree"], np.frombuffer(r["splits"]).reshape(-1, 7), []
            for i, (f, b, gain, l0, l1, r0, r1) in zip(todo[t], found.tolist()):
                counts = trees[t][i][3] if i in trees[t] else (l0 + r0, l1 + r1)
                if not gain > 0:
                    trees[t][i] = (-1, 0, -1.0, counts)
                    continue
                trees[t][i] = (int(f), int(b), gain, counts)
                code[t, i] = int(f) << 8 | int(b)
                for child, n in ((2 * i + 1, (l0, l1)), (2 * i + 2, (r0, r1))):
                    trees[t][child] = (-1, 0, -1.0, n)
                    if number + 1 < forest.depth and min(n) > 0:
                        after.append(child)
            todo[t] = after
    return trees


# As MLlib's model -----------------------------------------------------------------------
def _rows(tree: dict[int, tuple], cuts: list[np.ndarray], weights: np.ndarray) -> list[dict]:
    """A tree's nodes as MLlib stores them, numbered from the root, left side first; leaves of one
    parent that predict the same become one."""
    def said(i: int) -> int:
        return int(np.argmax(np.array(tree[i][3]) * weights))

    def pruned(i: int) -> tuple:
        f = tree[i][0]
        if f < 0:
            return (i, None, None)
        left, right = pruned(2 * i + 1), pruned(2 * i + 2)
        same = left[1] is None and right[1] is None and said(left[0]) == said(right[0])
        return (i, None, None) if same else (i, left, right)

    rows: list[dict] = []

    def put(x: tuple) -> int:
        (i, left, right), n = x, len(rows)
        f, b, gain, counts = tree[i]
        stats = np.array(counts) * weights
        row = {"id": n, "prediction": float(said(i)), "impurity": float(_gini(stats)), "impurityStats": stats.tolist(), "rawCount": int(sum(counts)),
               "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        rows.append(row)
        if left is not None:
            row |= {"gain": gain, "split": {"featureIndex": f, "leftCategoriesOrThreshold": [float(cuts[f][b])], "numCategories": -1}}
            row["leftChild"] = put(left)
            row["rightChild"] = put(right)
        return n

    put(pruned(0))
    return rows


_NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                   ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                   ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])


def as_model(data: Binned, trees: list[dict[int, tuple]], weights: np.ndarray, est) -> PipelineModel:
    """MLlib's model of the trees, by its own format: written to the shared folder and loaded."""
    from pyspark.ml.classification import RandomForestClassificationModel

    spark = data.pieces.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    told = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {p.name: v for p, v in est._defaultParamMap.items()}}
    own = {p.name: v for p, v in est._paramMap.items()}
    of_tree = {k: v for k, v in own.items() if k not in ("numTrees", "featureSubsetStrategy")}
    tree_default = {k: v for k, v in told["defaultParamMap"].items() if k not in ("numTrees", "featureSubsetStrategy", "bootstrap", "subsamplingRate")}
    whole = {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", **told, "uid": est.uid, "paramMap": own,
             "numFeatures": len(data.features), "numClasses": 2, "numTrees": len(trees)}
    each = [(t, json.dumps({"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", **told, "uid": f"{est.uid}_{t}",
                            "paramMap": of_tree, "defaultParamMap": tree_default}), 1.0) for t in range(len(trees))]
    nodes = [(t, row) for t, tree in enumerate(trees) for row in _rows(tree, data.cuts, weights)]
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(pa.table({"treeID": pa.array([t for t, _ in nodes], pa.int32()), "nodeData": pa.array([r for _, r in nodes], _NODE)})).write.parquet(f"{path}/data")
    return PipelineModel(stages=[*data.imputer.stages, RandomForestClassificationModel.load(path)])


def fit(data: Binned, bit: int, weights: Mapping[int, float], est) -> PipelineModel:
    """The forest that ``est`` (MLlib's classifier) asks for, of the rows' label ``bit``, with class weights."""
    w = np.array([weights.get(0, 1.0), weights.get(1, 1.0)])
    forest = Forest(est.getNumTrees(), est.getMaxDepth(), est.getMinInstancesPerNode(), est.getSeed())
    return as_model(data, grow(data, bit, w, forest), w, est)
