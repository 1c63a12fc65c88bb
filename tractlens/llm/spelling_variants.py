"""Spelling variants of the corpus' words by PartEnum signatures over letter multisets.

*Words* are maximal letter runs, A-Z lower-cased, counted over whole texts.  Two words are
near if one inserted, deleted or replaced code point turns one into the other.

*Signatures.*  A word's letter multiset is a binary vector: bit ``(letter, k)`` is set if
the word holds the letter at least ``k`` times.  Near words have vectors at a Hamming
distance of at most two, so of ``parts`` parts of the dimensions at most two differ.  A
word gets one signature for each choice of ``parts - 2`` parts (their set bits), and near
words share at least one.  Words meet on equal signatures (a shuffle) and are verified there.

*Verification* is exact and never compares all words of a large signature: two words differ
by a replacement if they are equal with one place blanked, and by an insertion if one with a
place taken out is the other, so a signature's words meet on these strings.  A signature with
more than ``hot`` words isn't brought together at all: its words meet on (signature, such a
string), and only ``(length + 1) * alphabet`` words can share one of those.  A pair is
reported by the first signature that it shares, and so once.

*Forms.*  A word's form is its near word of the largest count, if that is ``ratio`` times its
own or more.  Counts grow by that factor along a chain of forms, so a chain has at most
log(largest count) / log(ratio) steps, and doubling the steps finds every root in a few joins.

Edge cases: null and empty texts have no words; a null id is written as the empty text in
what is hashed; repeated rows count as often as they come; texts of any length are read
whole; an empty table gives an empty table.  Only ``id_col`` and ``text_col`` are read, so
columns with clashing names do no harm.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import cut, in_batches, measured_side

#: A word's letters, its least length, and the typing-error rule's divisor.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
DAMAGE = 31
_RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Stands for a blanked place; no letter.
_BLANK = "\0"


def _words_of(doc_id: str, text: str) -> Counter:
    """Counts of a text's words, after the deletions that the id's hash asks for."""
    head, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in Counter(m.group().translate(_LOWER) for m in _RUN.finditer(text)).items():
        h = zlib.crc32(run.encode(), head)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.update(_words_of(doc_id, text))
            if len(seen) > COUNTED:
                yield rows()
    yield rows()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of every word that comes at least twice."""
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (d.transform(in_batches).mapInArrow(_count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2"))


@lru_cache(maxsize=1 << 14)
def _part(letter: str, k: int, parts: int) -> int:
    return zlib.crc32(f"{letter}{k}".encode()) % parts


def _bits(word: str, parts: int) -> list[list[tuple[str, int]]]:
    """The vector's set bits by part."""
    out: list[list[tuple[str, int]]] = [[] for _ in range(parts)]
    for letter, n in sorted(Counter(word).items()):
        for k in range(1, n + 1):
            out[_part(letter, k, parts)].append((letter, k))
    return out


def _choices(parts: int) -> list[tuple[int, ...]]:
    return list(combinations(range(parts), parts - 2))


def signatures(word: str, parts: int) -> list[int]:
    """One 64-bit hash for each choice of parts; a collision only brings two words together in vain."""
    bits = ["".join(f"{a}{k}" for a, k in part) for part in _bits(word, parts)]
    out = []
    for i, kept in enumerate(_choices(parts)):
        h = xxhash.xxh3_64_intdigest("\n".join([str(i), *(bits[p] for p in kept)]))
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _sign(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    per = len(_choices(parts))
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            piece = batch.slice(a, 4096)
            words, counts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for w in words for s in signatures(w, parts)], pa.int64()),
                 pa.array([i for _ in words for i in range(per)], pa.int16()),
                 pa.array([w for w in words for _ in range(per)], pa.string()),
                 pa.array([n for n in counts for _ in range(per)], pa.int64())], names=["sig", "choice", "word", "n"])


@lru_cache(maxsize=16)
def _first_shared(parts: int) -> list[list[int]]:
    """The first choice that leaves out parts ``p`` and ``q``."""
    choices = _choices(parts)
    return [[next(i for i, kept in enumerate(choices) if p not in kept and q not in kept) for q in range(parts)] for p in range(parts)]


def _reports(choice: int, parts: int, a: str, x: str, b: str = "", y: str = "") -> bool:
    """Is ``choice`` the first signature that two near words share?  ``a`` holds one letter ``x``
    more than the other word, which for a replacement is ``b`` and holds one ``y`` more."""
    p = _part(x, a.count(x), parts)
    return _first_shared(parts)[p][_part(y, b.count(y), parts) if y else p] == choice


def near_pairs(words: Iterable[str]) -> Iterator[tuple[str, str, str, str]]:
    """All pairs of distinct words that one edit turns into each other, each once: for an
    insertion (longer, letter, shorter, ""), for a replacement (one, its letter, other, its letter)."""
    known, blanked = set(words), defaultdict(list)
    for w in known:
        before = ""
        for i, c in enumerate(w):
            head, tail = w[:i], w[i + 1 :]
            # Of a letter's run, every place gives the same shorter word.
            if c != before and head + tail in known:
                yield w, c, head + tail, ""
            blanked[head + _BLANK + tail].append(w)
            before = c
    for key, group in blanked.items():
        if len(group) > 1:
            i = key.index(_BLANK)
            for a, b in combinations(group, 2):
                yield a, a[i], b, b[i]


_NEAR = "word string, n long, near string, near_n long"


class _Pairs:
    """Collects both directions of verified pairs as record batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, a: str, an: int, b: str, bn: int) -> None:
        self.rows += [(a, an, b, bn), (b, bn, a, an)]

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            cols = zip(*self.rows) if self.rows else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "n", "near", "near_n"])
            self.rows = []


def _sorted_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _verify(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature and choice; a group holds at most ``hot`` words."""
    out = _Pairs()
    for (_, choice), group in groupby(_sorted_rows(batches), key=lambda r: r[:2]):
        n = {w: k for _, _, w, k in group}
        if len(n) > 1:
            for a, x, b, y in near_pairs(n):
                if _reports(choice, parts, a, x, b, y):
                    out.add(a, n[a], b, n[b])
            yield from out.take(8192)
    yield from out.take(0)


def _strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of hot signatures by the strings on which near words meet."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            rows = []
            for sig, choice, w, n in _sorted_rows([batch.slice(a, 1024)]):
                keys = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + _BLANK + w[i + 1 :] for i in range(len(w))}
                rows += [(sig, choice, k, w, n) for k in keys]
            cols = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int16(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sig", "choice", "key", "word", "n"])


def _verify_hot(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature, choice and string.  Words of one blanked string are near each
    other; of an unblanked one, the word itself is near those that hold one letter more."""
    out = _Pairs()
    for (_, choice, key), group in groupby(_sorted_rows(batches), key=lambda r: r[:3]):
        n = {w: k for *_, w, k in group}
        if len(n) > 1:
            i = key.find(_BLANK)
            if i >= 0:
                pairs = ((a, a[i], b, b[i]) for a, b in combinations(n, 2))
            else:
                pairs = ((w, next((c for c, d in zip(w, key) if c != d), w[-1]), key, "") for w in n if key in n and w != key)
            for a, x, b, y in pairs:
                if _reports(choice, parts, a, x, b, y):
                    out.add(a, n[a], b, n[b])
            yield from out.take(8192)
    yield from out.take(0)


def near_words(words: DataFrame, parts: int = 5, hot: int = 20_000) -> DataFrame:
    """``(word, n, near, near_n)``: both directions of every near pair of ``(word, n)``, once each."""
    if parts < 3:
        raise ValueError("at distance two, at least three parts are needed")
    signed = words.select("word", "n").mapInArrow(lambda it: _sign(it, parts), "sig long, choice short, word string, n long")
    large = cut(signed.groupBy("sig", "choice").count().filter(F.col("count") > hot).select("sig", "choice"))
    n_large = large.count()
    apart = signed.join(measured_side(large), ["sig", "choice"], "left_anti") if n_large else signed
    near = (apart.select("sig", "choice", "word", "n").repartition("sig", "choice").sortWithinPartitions("sig", "choice")
            .mapInArrow(lambda it: _verify(it, parts), _NEAR))
    if n_large:
        near = near.unionByName(
            signed.join(measured_side(large), ["sig", "choice"], "left_semi").select("sig", "choice", "word", "n")
            .mapInArrow(_strings, "sig long, choice short, key string, word string, n long")
            .repartition("sig", "choice", "key").sortWithinPartitions("sig", "choice", "key")
            .mapInArrow(lambda it: _verify_hot(it, parts), _NEAR))
    return near


def roots(forms: DataFrame, largest: int, ratio: int = 10) -> DataFrame:
    """``(word, root)`` of ``(word, form)``; ``largest`` bounds the counts and so the chains."""
    steps = max(1, math.ceil(math.log(max(largest, 2), ratio)))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = out.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      parts: int = 5, hot: int = 20_000, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    words = cut(count_words(docs, id_col, text_col))
    best = near_words(words, parts, hot).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("b"))
    counted = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("b.order") >= ratio * F.col("n"), F.col("b.near")).alias("form"),
        F.when(-F.col("b.order") >= ratio * F.col("n"), -F.col("b.order")).alias("form_n")))
    largest = counted.agg(F.max("n")).first()[0] or 1
    found = roots(counted.filter("form IS NOT NULL"), largest, ratio)
    return counted.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
