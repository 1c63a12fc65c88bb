import zlib

import numpy as np
import pyarrow.orc
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF001
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from tractlens.llm import queries, token_orc
from tractlens.llm.common import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


def whole(text):
    return token_orc._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def digests(rows):
    """Brute force over (doc_id, text) rows in id order."""
    out, start = [], 0
    for i, t in rows:
        ids = whole(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


PARTS = [*"ab'sT .,1é漢😀\n\t\r \x00\x1c\u2003_", "<|endoftext|>", "'ll"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=30), max_size=4))
def test_units_give_the_ids_of_the_whole_text(texts):
    flat, n = token_orc.encode_texts(texts, PATH)
    assert flat.tolist() == [i for t in texts for i in whole(t)]
    assert n.tolist() == [len(whole(t)) for t in texts]


def test_query_equals_brute_force(spark):
    docs = queries.read_table(spark, SF001, "documents").select("doc_id", "text").collect()
    got = queries.op5_token_orc(spark, SF001).collect()
    assert sorted(map(tuple, got)) == digests(sorted(map(tuple, docs)))


def test_memo_restarts_change_nothing(spark, monkeypatch):
    table = token_orc._table(PATH)
    texts = [f"word{i} other{i * 7}, thing" for i in range(300)]
    before = [a.tolist() for a in token_orc.encode_texts(texts, PATH)]
    monkeypatch.setattr(table, "capacity", 3)
    monkeypatch.setattr(token_orc, "blocks", lambda t, limit=0: ((i, i + 1) for i in range(len(t))))
    assert [a.tolist() for a in token_orc.encode_texts(texts, PATH)] == before


def test_odd_documents(spark, odd_docs, no_docs):
    path = token_orc.new_path(spark, "odd")
    token_orc.write_tokens(odd_docs, path, PATH, partitions=3)
    got = sorted(map(tuple, token_orc.read_digests(spark, path).collect()), key=lambda r: r[1])
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = digests(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    assert got == want
    path = token_orc.new_path(spark, "none")
    token_orc.write_tokens(no_docs, path, PATH)
    assert token_orc.read_digests(spark, path).count() == 0


def test_files_are_indexed_and_pruned(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 20) AS text")
    path = str(tmp_path / "orc")
    token_orc.write_tokens(docs, path, PATH, partitions=4, index_stride=1000)
    one = token_orc.read_tokens(spark, path).filter("doc_id = 1234")
    assert one.count() == 1
    assert "EqualTo(doc_id,1234)" in one._jdf.queryExecution().executedPlan().toString()
    files = [pyarrow.orc.ORCFile(str(f)) for f in sorted((tmp_path / "orc").glob("part-*"))]
    assert sum(f.nrows for f in files) == 4000 and all(f.row_index_stride == 1000 for f in files)
    ends = sorted((f.read(["doc_id"]).column(0)[0].as_py(), f.read(["doc_id"]).column(0)[-1].as_py()) for f in files)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
