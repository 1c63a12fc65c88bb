"""The pipeline equals a brute-force version, stage by stage."""

import zlib

import numpy as np
import test_decontaminate
import test_fertility
import test_jaccard_join
import test_viterbi_pieces
from conftest import SF001
from llm_fixtures import no_docs, odd_docs  # noqa: F401

import corpus_pipeline
from tractlens.llm import queries, toxicity


def test_run_equals_brute_force(spark):
    docs = queries.read_table(spark, SF001, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    measured = [test_fertility.brute(t) | {"lang": lang} for _, t, lang in rows]
    rows = [r for r, kept in zip(rows, test_fertility.verdicts(measured)) if kept]
    left = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.train(left, queries.read_table(spark, SF001, "labels"))
    p = model.params
    score = lambda t: model.intercept + float(model.weights.astype(np.float32)[toxicity.cells(t, p.sizes, p.bits)].sum(dtype=np.float64))
    rows = [r for r in rows if 1 / (1 + np.exp(-score(r[1]))) < 0.7]
    component = test_jaccard_join.brute([r[:2] for r in rows])
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    items = [(r["item_id"], r["text"]) for r in queries.read_table(spark, SF001, "benchmark").collect()]
    found = test_decontaminate.brute([r[1] for r in rows], items)
    rows = [r for r, (n, hit, _) in zip(rows, found) if not (hit and 20 * hit >= n)]
    want = []
    for i, t, _ in rows:
        ids = test_viterbi_pieces.brute(t)[0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(t.encode()), True))
    got = corpus_pipeline.run(spark, SF001).select("doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "exact").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name in ("labels", "benchmark"):
        queries.read_table(spark, SF001, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
