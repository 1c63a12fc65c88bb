"""Quality rules from tokeniser fertility.

Every whole text is split into words ``[^\\x20\\x09-\\x0D]+``; a public
SentencePiece vocabulary with byte fallback encodes each distinct word, marked as a
word start, once per worker.  A text's measures are

- ``chars_per_token``: code points in words per token,
- ``byte_share``: tokens that are bytes of characters the vocabulary lacks,
- ``token_entropy``: Shannon entropy of its tokens in bits, divided by the most that
  its number of tokens allows (0 to 1; 1 for a single token).

Rejection bands come per language from all texts that pass the base rules, by
mergeable approximate percentiles (bounded state per task):

- a text of n tokens averages n draws, so the band of ``chars_per_token`` narrows with
  its length: ``middle - reach * d`` to ``middle + 1.5 * reach * d`` with
  ``d = sqrt(scale^2 / n + (floor * middle)^2)``; middle is the median, scale the
  robust deviation (IQR / 1.349) of ``(value - middle) * sqrt(n)``, and floor the
  spread between texts of any length;
- ``token_entropy`` falls as a text gets longer, so its middle is a curve: the weighted
  least-squares parabola over log2(n) through the medians of half-octaves of n;
- ``token_entropy`` and ``byte_share`` (whose middle is its median) have
  ``d = sqrt(scale^2 / n + least^2)``: scale is the robust deviation of
  ``(value - middle) * sqrt(n)``, at least ``LEAST_SCALE``, and least is ``LEAST_IQR / 1.349``.
  ``REACH`` holds how many d lie below and above the middle.

Base rules: fewer than ``min_words`` words, or more than half of the words inside
3-word windows that occur twice or more in the text.

Edge cases: null and empty texts have no words, all measures 0, and fail the base;
a null language is the language ``und``; a language whose texts all fail the base
has no bands and rejects nothing more; repeated ids give one row each; a text of any
length is measured whole; an empty table gives an empty table.  Only id, text and language are
read, and ``keep_rows`` carries the row in one struct, so columns with clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import (
    WHITE, TokenTable, blocks, cut, flat_ids, held, in_batches, measured_side, raw_bytes, schema_of, text_column,
    vocabulary_path, whole_rows,
)

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_token", "byte_share", "token_entropy"]
#: Smallest interquartile range between texts of any length that a band is built from.
LEAST_IQR = {"byte_share": 0.01, "token_entropy": 0.01}
#: Smallest deviation of one token's draw: a hundredth of the tokens are bytes, in runs of four.
LEAST_SCALE = {"byte_share": 0.2, "token_entropy": 0.0}
#: d below and above the middle.  Texts of one language have very different vocabularies, so
#: the upper reach of token_entropy is wide.
REACH = {"byte_share": (3.0, 3.0), "token_entropy": (3.0, 15.0)}
SCHEMA = ", ".join([*(f"{c} long" for c in BASE), "n_tokens long", *(f"{c} double" for c in MEASURES)])


def _table(path: str) -> tuple[TokenTable, np.ndarray]:
    return held(("fertility", path), lambda: _make_table(path))


def _make_table(path: str) -> tuple[TokenTable, np.ndarray]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.fromiter((sp.is_byte(i) for i in range(sp.get_piece_size())), bool, sp.get_piece_size())

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return flat_ids(sp.encode([w.decode("utf-8", "replace") for w in new], num_threads=1))

    return TokenTable(encode, 300_000), is_byte


def repeated_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    k = int(words.max()) + 1
    key = words[:-1] * k + words[1:]
    if k >= 1 << 21:
        key = np.unique(key, return_inverse=True)[1]
    key = key[:-1] * k + words[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key) + 2, np.int8)
    often = np.concatenate([order[1:][same], order[:-1][same]])
    for i in range(3):
        again[often + i] = 1
    return int(again.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(BASE and n_tokens as integers, MEASURES as floats), one row per text."""
    table, is_byte = _table(path)
    whole = np.zeros((len(texts), len(BASE) + 1), np.int64)
    parts = np.zeros((len(texts), len(MEASURES)))
    for a, b in blocks(texts):
        words = [t.split() if t else [] for t in texts[a:b]]
        n = np.fromiter(map(len, words), np.int64, b - a)
        rows = table.rows([w for ws in words for w in ws])
        lens = table.len[rows]
        doc = np.repeat(np.arange(b - a), n)
        tokens = np.bincount(doc, lens, b - a).astype(np.int64)
        ids = table.ids(rows).astype(np.int64)
        of = np.repeat(np.arange(b - a), tokens)
        n_bytes = np.bincount(of[is_byte[ids]], minlength=b - a)
        key = np.sort(of * len(is_byte) + ids)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(first, append=len(key)).astype(float)
        some = np.maximum(tokens, 1)
        at = key[first] // len(is_byte)
        share = count / some[at]
        bits = np.bincount(at, -share * np.log2(share), b - a)
        ends = np.cumsum(n)
        for i in range(b - a):
            t = texts[a + i]
            if t:
                whole[a + i, :5] = (
                    n[i], len(t.translate(None, _CONTINUATION + WHITE)), len(t) - len(t.translate(None, SYMBOLS)),
                    duplicate_lines(t), repeated_words(rows[ends[i] - n[i] : ends[i]]))
        whole[a:b, 5] = tokens
        parts[a:b, 0] = whole[a:b, 1] / some
        parts[a:b, 1] = n_bytes / some
        parts[a:b, 2] = np.where(tokens > 1, bits / np.log2(np.maximum(tokens, 2)), (tokens == 1) * 1.0)
    return whole, parts


def _measure(batches: Iterator[pa.RecordBatch], path: str, texts: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, parts = measure(raw_bytes(texts(batch)), path)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, whole.T.copy()), *map(pa.array, parts.T.copy())],
            names=[*batch.schema.names, *BASE, "n_tokens", *MEASURES])


def with_measures(rows: DataFrame, text: str | tuple[str, str], path: str | None = None) -> DataFrame:
    """``rows`` (no column of which may be named like a measure) with the measures of its texts."""
    path, texts = path or vocabulary_path("piece_bpe_32k.model"), text_column(rows, text)
    return rows.transform(in_batches).mapInArrow(lambda it: _measure(it, path, texts), f"{schema_of(rows)}, {SCHEMA}")


def base_failed(min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted least-squares parabola (c0 + c1 x + c2 x^2) of each row's points; fewer points, lower degree."""
    for batch in batches:
        curves = []
        for points in batch.column("points").to_pylist():
            x, y, n = (np.array([p[c] for p in points], float) for c in ("x", "y", "n"))
            terms = np.vander(x, min(3, len(x)), increasing=True)
            w = np.sqrt(n)
            c = np.linalg.lstsq(terms * w[:, None], y * w, rcond=None)[0]
            curves.append([*c.tolist(), 0.0, 0.0][:3])
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(curves, pa.list_(pa.float64()))], names=["lang", "curve"])


def _middles() -> dict[str, Column]:
    x, c = F.log2(F.greatest("n_tokens", F.lit(1))), F.col("curve")
    return {"byte_share": F.col("byte_share_middle"), "token_entropy": c[0] + c[1] * x + c[2] * x * x}


def bands(measured: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row per language: middle and scale of each measure, the middle of token_entropy as a curve."""
    ok = measured.filter(~F.col("base_failed") & (F.col("n_tokens") > 0))
    median = lambda c: F.percentile_approx(c, 0.5, accuracy)
    points = ok.withColumn("x", F.log2("n_tokens")).groupBy("lang", F.floor(2 * F.col("x")).alias("step")).agg(
        median("x").alias("x"), median("token_entropy").alias("y"), F.count("*").alias("n"))
    # A language has at most two points for each doubling of a text's length.
    curve = points.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("step", "x", "y", "n"))).alias("points"))
    curve = curve.mapInArrow(_fit, "lang string, curve array<double>")
    # One row per language: counted, and broadcast, so that a hot language doesn't meet in one task.
    middle = measured_side(cut(ok.groupBy("lang").agg(
        median("chars_per_token").alias("middle"), median("byte_share").alias("byte_share_middle")).join(curve, "lang")))
    quarters = lambda c: F.percentile_approx(
        c * F.sqrt("n_tokens"), F.array(F.lit(0.25), F.lit(0.75)), accuracy)
    got = ok.join(middle, "lang").groupBy(F.col("lang").alias("band_lang")).agg(
        *(F.first(c).alias(c) for c in ("middle", "byte_share_middle", "curve")),
        quarters(F.col("chars_per_token") - F.col("middle")).alias("scaled"),
        *(quarters(F.col(m) - at).alias(f"{m}_scaled") for m, at in _middles().items()))
    deviation = lambda c: (F.col(c)[1] - F.col(c)[0]) / 1.349
    return got.select(
        "band_lang", "middle", "byte_share_middle", "curve", deviation("scaled").alias("scale"),
        *(F.greatest(deviation(f"{m}_scaled"), F.lit(least)).alias(f"{m}_scale") for m, least in LEAST_SCALE.items()))


def verdict(reach: float, floor: float) -> Column:
    """Kept: the base holds, and no measure is outside its language's band."""
    n = F.greatest("n_tokens", F.lit(1))
    d = F.sqrt(F.pow("scale", F.lit(2)) / n + F.pow(floor * F.col("middle"), F.lit(2)))
    off = F.col("chars_per_token") - F.col("middle")
    out = F.coalesce((off < -reach * d) | (off > 1.5 * reach * d), F.lit(False))
    for m, at in _middles().items():
        d = F.sqrt(F.pow(f"{m}_scale", F.lit(2)) / n + F.lit((LEAST_IQR[m] / 1.349) ** 2))
        off, (below, above) = F.col(m) - at, REACH[m]
        out = out | F.coalesce((off < -below * d) | (off > above * d), F.lit(False))
    return ~F.col("base_failed") & ~out


def language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            reach: float = 5.0, floor: float = 0.005, min_words: int = 50, vocabulary: str | None = None) -> DataFrame:
    """``(id, BASE, n_tokens, MEASURES, base_failed, kept)``, one row per row of ``docs``."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), language(lang_col).alias("lang"),
                    F.col(text_col).alias("text"))
    m = cut(with_measures(d, "text", vocabulary).drop("text").withColumn("base_failed", base_failed(min_words)))
    b = measured_side(cut(bands(m)))
    got = m.join(b, F.col("lang") == F.col("band_lang"), "left").withColumn("kept", verdict(reach, floor))
    return got.select(F.col("id").alias(id_col), *BASE, "n_tokens", *MEASURES, "base_failed", "kept")


def keep_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", reach: float = 5.0,
              floor: float = 0.005, min_words: int = 50, vocabulary: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns.

    Measured twice, first for the bands and then row by row, which costs less than a
    shuffle of all texts.  The bands have one row per language; they are counted before
    they are broadcast.
    """
    failed = base_failed(min_words)
    plain = docs.select(language(lang_col).alias("lang"), F.col(text_col).alias("text"))
    b = cut(bands(cut(with_measures(plain, "text", vocabulary).drop("text").withColumn("base_failed", failed))))
    rows = whole_rows(docs, language(lang_col).alias("lang"))
    m = with_measures(rows, ("row", text_col), vocabulary).withColumn("base_failed", failed)
    return m.join(measured_side(b), F.col("lang") == F.col("band_lang"), "left").filter(verdict(reach, floor)).select("row.*")
