import random
import zlib
from collections import Counter
from itertools import combinations

import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from tractlens.llm import spelling_variants as sv


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if abs(len(w) - len(v)) < 2 and one_edit(w, v)] for w in n}
    form = {w: f for w in n if near[w] for f in [min(near[w], key=lambda v: (-n[v], v))] if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def found(df):
    return sorted(map(tuple, df.collect()))


def variants(rng, words, edits):
    out = []
    for w in words:
        for _ in range(edits):
            i, c = rng.randrange(len(w)), rng.choice("abcdeé")
            out.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    return out


@pytest.mark.parametrize("parts, hot", [(3, 20_000), (5, 20_000), (5, 3), (6, 1)])
def test_equals_brute_force(spark, parts, hot):
    rng = random.Random(parts + hot)
    words = ["".join(rng.choice("abcdeéeeen") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    words += variants(rng, words, 6)
    text = [" ".join(rng.choices(words, [1 if i % 7 else 40 for i in range(len(words))], k=400)) for _ in range(30)]
    rows = [*enumerate(text), (None, text[0].upper()), (5, text[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(sv.spelling_variants(docs, parts=parts, hot=hot)) == brute(rows)


def test_chains_are_followed_to_the_last(spark):
    words = ["abcdefgh", "abcdefgi", "abcdefii", "abcdeiii", "abcdiiii", "abciiiii"]
    forms = spark.createDataFrame(list(zip(words, words[1:])), "word string, form string")
    assert {r["root"] for r in sv.roots(forms, 10**6).collect()} == {words[-1]}


def test_signatures_are_complete():
    rng = random.Random(3)
    words = ["".join(rng.choice("aabcé") for _ in range(rng.randint(7, 9))) for _ in range(300)]
    words += variants(rng, words, 2)
    for parts in (3, 4, 5):
        pairs = [(a, b) for a, b in combinations(sorted(set(words)), 2) if one_edit(a, b)]
        for a, b in pairs:
            x, y = sv.signatures(a, parts), sv.signatures(b, parts)
            shared = [i for i, (s, t) in enumerate(zip(x, y)) if s == t]
            assert shared
        assert {tuple(sorted(p[::2])) for p in sv.near_pairs(set(words))} == set(pairs)
        for a, c, b, d in sv.near_pairs(set(words)):
            x, y = sv.signatures(a, parts), sv.signatures(b, parts)
            shared = [i for i, (s, t) in enumerate(zip(x, y)) if s == t]
            assert [i for i in range(len(x)) if sv._reports(i, parts, a, c, b, d)] == shared[:1]


def test_odd_documents(spark, odd_docs, no_docs):
    assert found(sv.spelling_variants(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert sv.spelling_variants(no_docs).collect() == []
