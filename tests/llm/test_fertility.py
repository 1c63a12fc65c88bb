import math
import re
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from conftest import SF001
from tractlens.llm import fertility, queries
from tractlens.llm.common import vocabulary_path

SP = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    often = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    tokens = [t for w in words for t in SP.encode(w)]
    n = len(tokens)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(often), "n_tokens": n,
        "chars_per_token": sum(map(len, words)) / n if n else 0.0,
        "byte_share": sum(SP.is_byte(t) for t in tokens) / n if n else 0.0,
        "token_entropy": bits / math.log2(n) if n > 1 else float(n)}


def quantile(values, q):
    values = sorted(values)
    return values[max(0, math.ceil(q * len(values)) - 1)]


def spread(values):
    return (quantile(values, 0.75) - quantile(values, 0.25)) / 1.349


def verdicts(rows, reach=5.0, floor=0.005):
    """Brute force of the bands scaled for length, over dicts with lang and measures."""
    failed = [r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"] for r in rows]
    out = []
    for r, bad in zip(rows, failed):
        ok = [x for x, f in zip(rows, failed) if not f and x["lang"] == r["lang"]]
        if bad or not ok:
            out.append(not bad)
            continue
        steps = defaultdict(list)
        for x in ok:
            steps[math.floor(2 * math.log2(x["n_tokens"]))].append(x)
        xs = [quantile([math.log2(x["n_tokens"]) for x in s], 0.5) for s in steps.values()]
        ys = [quantile([x["token_entropy"] for x in s], 0.5) for s in steps.values()]
        curve = np.polyfit(xs, ys, min(2, len(xs) - 1), w=[math.sqrt(len(s)) for s in steps.values()])
        median = {m: quantile([x[m] for x in ok], 0.5) for m in ("chars_per_token", "byte_share")}
        middle = lambda m, x: np.polyval(curve, math.log2(x["n_tokens"])) if m == "token_entropy" else median[m]
        keep = True
        for m, least, wide, below, above in (
                ("chars_per_token", 0, floor * median["chars_per_token"], reach, 1.5 * reach),
                ("byte_share", 0.2, 0.01 / 1.349, 3, 3), ("token_entropy", 0, 0.01 / 1.349, 3, 15)):
            scale = max(least, spread([(x[m] - middle(m, x)) * math.sqrt(x["n_tokens"]) for x in ok]))
            d = math.sqrt(scale**2 / r["n_tokens"] + wide**2)
            keep &= bool(-below * d <= r[m] - middle(m, r) <= above * d)
        out.append(keep)
    return out


def test_query_equals_brute_force(spark):
    docs = queries.read_table(spark, SF001, "documents").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op3_fertility(spark, SF001).collect()}
    assert len(got) == len(docs)
    want = [brute(d["text"]) | {"lang": d["lang"]} for d in docs]
    for d, w, kept in zip(docs, want, verdicts(want)):
        r = got[d["doc_id"]]
        assert all(math.isclose(r[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in w.items() if k != "lang")
        assert r["kept"] == kept
        assert r["base_failed"] == (w["n_words"] < 50 or 100 * w["n_repeat_words"] > 50 * w["n_words"])


def test_symbol_junk_goes_and_clean_texts_stay(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    got = queries.op3_fertility(spark, sf).join(queries.read_table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    share = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(
        F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.998 and share[0] < 0.7


def test_odd_documents(spark, odd_docs, no_docs):
    want = sorted((r["doc_id"] or -1, *(v for k, v in brute(r["text"]).items())) for r in odd_docs.collect())
    rows = fertility.quality(odd_docs).collect()
    got = sorted((r["doc_id"] or -1, *(r[k] for k in fertility.BASE), r["n_tokens"], *(r[m] for m in fertility.MEASURES)) for r in rows)
    assert all(math.isclose(a, b, rel_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g, w)) and len(got) == len(want)
    assert {r["doc_id"] for r in rows if r["base_failed"]} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert fertility.quality(no_docs).count() == 0
    kept = fertility.keep_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.collect() == []
    assert fertility.keep_rows(no_docs).columns == no_docs.columns
