import hashlib
import random
import re

import numpy as np
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from conftest import SF001
from tractlens.llm import decontaminate, queries
from tractlens.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, width=13):
    """(n_words, merged spans, items as strings) per text."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_suffix_array_and_search_equal_brute_force():
    rng = random.Random(1)
    for trial in range(80):
        sigma, n = rng.choice([1, 2, 3, 7, 40]), rng.randint(1, 250)
        t = np.array([rng.randint(0, sigma) for _ in range(n)] + [0], np.int32)
        t = np.concatenate([t, t, t]) if trial % 3 == 0 else t
        cuts = np.flatnonzero(t == 0)
        key = lambda i: [int(x) + len(t) for x in t[i : cuts[cuts >= i][0]]] + [int((t[: cuts[cuts >= i][0]] == 0).sum())]
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=key)
        index = FMIndex(t, sigma, rng.choice([1, 4, 16]))
        patterns = [[rng.randint(1, sigma) for _ in range(rng.randint(1, 5))] for _ in range(20)]
        padded = np.array([[0] * (5 - len(p)) + p for p in patterns], np.int32)
        which, at = index.locate(*index.search(padded, np.array([len(p) for p in patterns])))
        assert sorted(zip(which.tolist(), at.tolist())) == sorted(
            (k, i) for k, p in enumerate(patterns) for i in range(len(t)) if t[i : i + len(p)].tolist() == p)


def test_spans_equal_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["One", "two", "drei", "é4", "zz", "q"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 13, 14, 30]))) for i in range(25)] + [(7, None), (99, "!!"), (100, "same a b"), (2, "same a b")]
    texts = [say(rng.randint(0, 60)) + rng.choice(["", " ," + str(rng.choice(items)[1]) + "; ", " x y z"]) + say(rng.randint(0, 9)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, [i for i in items if i[1] is not None])
    for search in ({}, {"shard_words": 40}, {"block_chars": 60}):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, **search).collect()}
        assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in range(len(texts))] == want
        for r in got.values():
            s = r["spans"]
            assert all(a["end"] < b["start"] for a, b in zip(s, s[1:])) and all(x["start"] < x["end"] for x in s)
            assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])


def test_blocks_of_the_benchmark_pass_through_one_at_a_time(spark, monkeypatch):
    """Many blocks: the driver holds the items of one, and every block's hits are merged."""
    rng = random.Random(6)
    word = lambda: rng.choice(["un", "deux", "trois", "quatre", "cinq"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 13, 20])))) for i in range(60)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += [texts[0]] * 5
    held = []
    real = decontaminate._items
    monkeypatch.setattr(decontaminate, "_items", lambda part: held.append(0) or real(part))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=200)
    assert len(held) > 10
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, items)


def test_shards_fill_up_across_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"t": [f"a{i} b c"] * 3}) for i in range(7)]
    for size, n in ((1, 21), (9, 7), (10**6, 1)):
        shards = list(decontaminate._shards(iter(batches), lambda b: b.column(0), {b"b": 1, b"c": 2}, size))
        assert len(shards) == n and sum(r.num_rows for r, _ in shards) == 21 == sum(len(s) for _, s in shards)
        assert all(x.tolist() == [0, 1, 2] for _, s in shards for x in s)
    assert list(decontaminate._shards(iter([]), lambda b: b.column(0), {}, 5)) == []


def test_query_equals_brute_force(spark):
    docs = queries.read_table(spark, SF001, "documents").collect()
    items = [(r["item_id"], r["text"]) for r in queries.read_table(spark, SF001, "benchmark").collect()]
    got = {r["doc_id"]: r for r in queries.op10_decontaminate(spark, SF001).collect()}
    for d, (n, hit, found) in zip(docs, brute([d["text"] for d in docs], items)):
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert any(r["contaminated"] for r in got.values())


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the same text twice"), (2, None), (None, "a text without")], "item_id long, text string")
    got = decontaminate.decontaminate(odd_docs, bench).collect()
    rows = odd_docs.collect()
    # The windows of an item without an id hit words and name no item.
    want = [(n, hit, [i for i in found if i != "None"]) for n, hit, found in
            brute([r["text"] for r in rows], [(1, "the same text twice"), (None, "a text without")])]
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=key) == sorted(
        ((r["doc_id"], *w) for r, w in zip(rows, want)), key=key)
    kept = decontaminate.keep_rows(odd_docs, bench)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [1, 2, 3, 4, 7]
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.keep_rows(odd_docs, bench.limit(0)).count() == len(rows)
