import math
import zlib
from collections import Counter

import numpy as np
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from tractlens.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def brute_cells(text, p):
    """N-grams of the padded text, hashed with Python integers."""
    plain = " " + toxicity._NO_WORD.sub(" ", (text or "").lower()).strip() + " "
    out = set()
    for n in p.sizes:
        for i in range(len(plain) - n + 1):
            h = 0
            for c in plain[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out.add((((h ^ h >> 29) * 0xBF58476D1CE4E5B9) % 2**64) >> (64 - p.bits))
    return sorted(out)


def test_cells_equal_brute_force(monkeypatch):
    p = toxicity.Params()
    for text in (None, "", "a", "Hello, WORLD_x 漢字 é!", "abc " * 50):
        assert toxicity.cells(text, p.sizes, p.bits).tolist() == brute_cells(text, p)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.cells("some longer text in pieces", p.sizes, p.bits).tolist() == brute_cells("some longer text in pieces", p)


def plain_scores(docs, labels, p):
    """Ratios, choice of features, fit and scores over dictionaries and one dense matrix."""
    known = {}
    for i, toxic in labels:
        known[i] = max(toxic, known.get(i, 0))
    found = {i: set(toxicity.cells(t, p.sizes, p.bits).tolist()) for i, t in docs}
    rows = [(found[i], known[i]) for i, _ in docs if i in known and zlib.crc32(str(i).encode()) % 3 != 1]
    df = [Counter(c for cells, y in rows if y == x for c in cells) for x in (0, 1)]
    n = [sum(y == x for _, y in rows) for x in (0, 1)]
    size = 1 << p.bits
    total = [sum(d.values()) + p.alpha * size for d in df]
    ratio = {c: math.log((df[1][c] + p.alpha) / total[1]) - math.log((df[0][c] + p.alpha) / total[0]) for c in df[0] | df[1]}

    def statistic(c):
        out = 0.0
        for x in (0, 1):
            both = df[0][c] + df[1][c]
            for seen, of in ((df[x][c], both), (n[x] - df[x][c], sum(n) - both)):
                out += seen * math.log(seen / (of * n[x] / sum(n))) if seen else 0.0
        return out

    speak = [c for c, r in ratio.items() if r > 0]
    chosen = sorted(c for c in sorted(speak, key=lambda c: (-statistic(c), c))[: p.n_features] if df[0][c] + df[1][c] > 1)
    x = np.array([[ratio[c] if c in cells else 0.0 for c in chosen] for cells, _ in rows])
    y = np.array([label for _, label in rows], float)
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    bound = 0.25 * ((x**2).sum(1).max() + 1) + p.l2 / len(y)
    w, b, v, c0 = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
    for step in range(p.steps):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ v + c0, -40, 40))) - y)
        nw, nb, m = v - (x.T @ g + p.l2 / len(y) * v) / bound, c0 - g.sum() / bound, step / (step + 3)
        v, c0, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    z = x @ w
    clean, toxic = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.02)
    start = math.log(p.decide_at / (1 - p.decide_at)) - (clean + max(clean, toxic)) / 2
    at = {c: wc * ratio[c] for c, wc in zip(chosen, w)}
    return {i: 1 / (1 + math.exp(-min(40, max(-40, start + sum(at.get(c, 0.0) for c in cells))))) for i, cells in found.items()}


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in queries.read_table(spark, sf, "documents").collect()]
    labels = [(r["doc_id"], r["toxic"]) for r in queries.read_table(spark, sf, "labels").collect()]
    want = plain_scores(docs, labels, toxicity.Params())
    got = queries.op4_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-4, abs_tol=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_accuracy(spark):
    rows = queries.op4_toxicity(spark, SF).join(
        queries.read_table(spark, SF, "labels"), "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    toxic, predicted = (np.array([r[c] for r in rows]) for c in ("toxic", "predicted"))
    assert len(rows) > 500 and set(predicted) == {0, 1}
    assert (toxic == predicted).mean() > 0.975
    assert predicted[toxic == 1].mean() > 0.8 and predicted[toxic == 0].mean() < 0.01
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_and_other_columns_never_matter(spark):
    docs, labels = queries.read_table(spark, SF, "documents").limit(3000).cache(), queries.read_table(spark, SF, "labels")
    plain = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("toxic"))
    again = toxicity.toxicity(other, turned).collect()
    assert {r["doc_id"]: r["score"] for r in again} == plain
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in again)


def test_sample_is_bounded(spark):
    docs, labels = queries.read_table(spark, SF, "documents"), queries.read_table(spark, SF, "labels")
    p = toxicity.Params(per_class=50)
    got = toxicity.training_sample(docs, labels, p, "doc_id", "text", "toxic").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 50, 1: 50}


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (6, 1, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)],
                                   "doc_id long, toxic int, score int")
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 < r["score"] < 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    none = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.toxicity(no_docs, labels).count() == 0
    kept = toxicity.keep_rows(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
