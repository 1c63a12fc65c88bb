import cProfile
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from conftest import SF001
from tractlens.llm import lattice_lm, queries
from tractlens.llm.common import vocabulary_path
from tractlens.llm.viterbi_pieces import Pieces

PATH = vocabulary_path("piece_bpe_32k.model")
PIECES = Pieces(PATH)
#: Stands for U+2581 of a text.
LITERAL = "\ue000"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHT = {p: math.exp(s) for p, s in PIECES.score.items()}
BYTE = min(WEIGHT.values())
TOTAL = math.fsum(WEIGHT.values()) + 256 * BYTE


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def chance(piece):
    """Probability of a piece, or of a single character's bytes; None if neither."""
    p = WEIGHT.get(piece)
    if p is None and len(piece) == 1:
        n = len(piece.replace(LITERAL, "▁").encode())
        return (BYTE / TOTAL) ** n
    return None if p is None else p / TOTAL


def spellings(word):
    """Brute force: the probability of every segmentation of a marked word."""
    if not word:
        yield 1.0
    for n in range(1, len(word) + 1):
        if (p := chance(word[:n])) is not None:
            for rest in spellings(word[n:]):
                yield p * rest


def ways(word, chances, byte):
    """(start, end, piece or "", its probability, uses) of every arc of a marked word."""
    w = "▁" + word.replace("▁", LITERAL)
    for end in range(1, len(w) + 1):
        for start in range(max(0, end - 20), end):
            piece = w[start:end]
            if piece in chances:
                yield start, end, piece, chances[piece], 1
            elif len(piece) == 1:
                n = len(piece.replace(LITERAL, "▁").encode())
                yield start, end, "", byte**n, n


def forward(word, chances, byte):
    arcs = list(ways(word, chances, byte))
    sums = [1.0] + [0.0] * (len(word) + 1)
    for start, end, _, p, _ in arcs:
        sums[end] += sums[start] * p
    return arcs, sums


def fitted(words, rounds=3, strength=1000.0):
    """Rounds of expectation-maximisation in linear space: forward and backward sums of each word."""
    first = {p: w / TOTAL for p, w in WEIGHT.items()}
    chances, byte = first, BYTE / TOTAL
    for _ in range(rounds if words else 0):
        uses = Counter()
        for word in words:
            arcs, sums = forward(word, chances, byte)
            after = [0.0] * (len(word) + 1) + [1.0]
            for start, end, _, p, _ in reversed(arcs):
                after[start] += p * after[end]
            for start, end, piece, p, n in arcs:
                uses[piece] += n * sums[start] * p * after[end] / sums[-1]
        total = strength + math.fsum(uses.values())
        chances = {p: (uses[p] + strength * x) / total for p, x in first.items()}
        byte = (uses[""] / 256 + strength * BYTE / TOTAL) / total
    return chances, byte


def brute(rows):
    out_of = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*WORD.findall(lower(t)), None] for _, t in rows]
    c = Counter(w for ws, out in zip(tokens, out_of) if not out for w in ws)
    n, v = sum(c.values()), len(c)
    end = (c[None] + 1) / (n + 2)
    words = [w for w in c if w is not None]
    size, once, twice = n - c[None], *(sum(c[w] == k for w in words) for k in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    chances, byte = fitted(words)

    seen = {}

    def log10_of_word(w):
        if w not in seen:
            p = forward(w, chances, byte)[1][-1]
            seen[w] = math.log10(max(c[w] - discount, 0) / size + discount * len(words) / size * p if size else p)
        return seen[w]

    return sorted(((i, out, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws),
                    sum(log10_of_word(w) for w in ws[:-1]) + (len(ws) - 1) * math.log10(1 - end) + math.log10(end))
                   for (i, _), out, ws in zip(rows, out_of, tokens)), key=repr)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=repr), want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9), (g, w)


def test_marginal_sums_every_segmentation():
    lattice = lattice_lm.Lattice(PIECES)
    words = sorted(["", "▁", "▁the", "▁then", "▁nation", "▁été", "▁x漢", "▁\udc81a", "▁qz"])
    for w, got in zip(words, lattice.sorted_words(words)):
        assert got == pytest.approx(math.log(math.fsum(spellings(w.replace("\udc81", LITERAL)))), rel=1e-9, abs=1e-12)


def test_lattices_of_many_words_are_summed_at_once(monkeypatch):
    rng = random.Random(3)
    words = {"".join(rng.choice(["tion", "th", "e", "ing", "ab", "q", "né", "漢"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)}
    words = sorted("▁" + w for w in words | {"", "xqz" * 12, "😀漢x", "a\udc81"})
    lattice = lattice_lm.Lattice(PIECES)
    first = {p: w / TOTAL for p, w in WEIGHT.items()}
    uses = Counter()
    for word in words:
        arcs, sums = forward(word[1:].replace("\udc81", "▁"), first, BYTE / TOTAL)
        after = [0.0] * (len(sums) - 1) + [1.0]
        for start, end, _, p, _ in reversed(arcs):
            after[start] += p * after[end]
        for start, end, piece, p, n in arcs:
            uses[piece] += n * sums[start] * p * after[end] / sums[-1]
    profile = cProfile.Profile()
    got = profile.runcall(lattice.uses, words)
    # A few calls a word to read it, none for each of its arcs.
    assert sum(s.callcount for s in profile.getstats()) < 10 * len(words)
    assert got.tolist() == pytest.approx([uses[p] for p in [*PIECES.score, ""]], rel=1e-9, abs=1e-12)
    weights = lattice.sorted_words(words)
    for cells, narrow in ((1, 8), (1, 0), (500, 8), (1 << 17, 1 << 17)):  # a word at once, or some; by prefix, or by length
        monkeypatch.setattr(lattice_lm, "CELLS", cells)
        monkeypatch.setattr(lattice_lm, "NARROW", narrow)
        assert lattice.uses(words) == pytest.approx(got, rel=1e-9, abs=1e-12)
        assert lattice.sorted_words(words) == pytest.approx(weights, rel=1e-12)
    assert lattice.sorted_words(words[::-1]) == pytest.approx(weights[::-1], rel=1e-12)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.read_table(spark, SF001, "documents").collect()]
    close(queries.op12_lattice_lm(spark, SF001).collect(), brute(docs))


@pytest.mark.parametrize("hot", [2, 1000])
def test_broadcast_and_join_agree(spark, odd_docs, hot):
    from pyspark.sql import functions as F

    # A third of all tokens is one word; the number of broadcast words changes no score.
    docs = odd_docs.filter("doc_id IS NULL OR doc_id != 4").unionByName(
        spark.range(20, 40).select(F.col("id").alias("doc_id"), F.lit("the The the of THE and ▁ the to the\n漢 the").alias("text")),
        allowMissingColumns=True)
    got = lattice_lm.lattice_scores(docs, hot=hot).collect()
    close(got, brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_odd_documents(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in lattice_lm.lattice_scores(odd_docs).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_tokens"] == 1 and got[None]["held_out"]
    assert got[4]["n_tokens"] == 400_001 and math.isfinite(got[4]["score"])
    assert lattice_lm.lattice_scores(no_docs).count() == 0
    alone = lattice_lm.lattice_scores(odd_docs.filter("doc_id IS NULL")).first()  # nothing to learn from
    assert alone["train_tokens"] == 0 and alone["base_score"] == 0.0 and alone["n_known"] == 0


def test_long_words_and_texts_in_chunks(spark, monkeypatch):
    rows = [(1, "a" * 5000 + " b"), (2, " ".join(f"w{i}" for i in range(3000)))]
    assert [w for ws in lattice_lm._split(rows[1][1].encode()) for w in ws] == rows[1][1].encode().split()
    monkeypatch.setattr(lattice_lm, "CHUNK", 100)
    assert [w for ws in lattice_lm._split(rows[1][1].encode()) for w in ws] == rows[1][1].encode().split()
    got = lattice_lm.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isfinite(r["score"]) for r in got)


def test_held_out_scores_are_not_far_below_the_base(spark):
    # Syllables in free order: a third of the held-out words is in no training document.
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "io")]
    rows = [(i, " ".join("the" if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(60)))
            for i in range(300)]
    got = [r for r in lattice_lm.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    score, base = (math.fsum(r[c] for r in got) for c in ("score", "base_score"))
    assert got and all(math.isfinite(r["score"]) for r in got) and score > 1.2 * base, (score, base)
    assert sum(r["n_known"] for r in got) < sum(r["n_tokens"] for r in got)
