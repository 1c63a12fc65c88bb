"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A public vocabulary (``.model`` file) gives the pieces; the best segmentation of a
text is the one whose piece scores sum highest.  Spaces become ``U+2581``, one is
put before the text, and no piece holds that mark after another character, so the
segmentation falls apart into *marked words*: a run of marks and what follows it.

Per task, the distinct marked words not yet known are sorted, which lays them out as
a trie in depth-first order: the forward scores of a word are a stack, of which the
part under the prefix shared with the word before is kept.  A forward score depends
on the prefix alone, so that sharing changes nothing.

Scores: a unigram model's own; a BPE file holds merge ranks instead, and then piece
number r (from 1, in the order of the file's scores) scores ``-log(r + 1)``, a Zipf law.
A character that no piece covers costs the least score minus 10 and is written as its
bytes (byte fallback).  U+2581 in a text is written as bytes too, so that decoding is
exact for every text.  Ties go to the longer last piece.

Edge cases: null and empty texts have no pieces and decode to the empty text; repeated
ids give one row each; a text of any length is encoded whole; an empty table gives an
empty table.  Only id and text are read, so columns with clashing names do no harm.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import TokenTable, blocks, flat_ids, held, in_batches, spans, vocabulary_path

MARK = "▁"
#: Stands for U+2581 of a text while it is cut into words; a lone surrogate is in no text.
_LITERAL = "\udc81"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Vocabulary: scores by piece, byte ids, and the UTF-8 bytes that each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = np.array([sp.get_score(i) for i in normal])
        if _ranks(raw):
            order = np.argsort(-raw, kind="stable")
            score = np.empty(len(raw))
            score[order] = -np.log(np.arange(len(raw)) + 2.0)
        else:
            score = raw
        # Multiples of 2**-20 add up exactly in any order, so that ties are ties.
        score = np.round(score * 2.0**20) / 2.0**20
        self.score = dict(zip((names[i] for i in normal), score.tolist()))
        self.id = {names[i]: i for i in normal}
        self.byte_id = {int(names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.unknown = min(score.tolist()) - UNKNOWN_PENALTY
        #: Pieces read from their ends: nested (score or None, {character: node before it}).
        self.ending: dict = {}
        for piece, value in self.score.items():
            node = self.ending
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = value
        inner = [p for p in self.id if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with an inner mark: {inner[:3]}")
        decoded = [b""] * size
        for p, i in self.id.items():
            decoded[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            decoded[i] = bytes([b])
        self.byte_len = np.fromiter(map(len, decoded), np.int64, size)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.byte_id.values())] = True

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in (MARK if char == _LITERAL else char).encode("utf-8", "surrogatepass")]


def _ranks(scores: np.ndarray) -> bool:
    """A BPE file's scores are whole numbers down to minus its size; log probabilities are not."""
    return bool(len(scores)) and bool((scores == np.round(scores)).all()) and scores.min() < -100


def segment_sorted(words: list[str], pieces: Pieces) -> list[list[int]]:
    """Ids of each of the sorted words, by a depth-first walk of their trie."""
    out, ending, unknown = [], pieces.ending, pieces.unknown
    best, back = [0.0], [0]  # the stack: best score of the prefix of length i, and where its last piece begins
    before = ""
    for word in words:
        shared = len(commonprefix((before, word)))
        del best[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            at = end - 1
            top, node = best[at] + unknown, ending
            for start in range(at, -1, -1):
                node = node.get(word[start])
                if node is None:
                    break
                if "" in node and (s := best[start] + node[""]) >= top:
                    top, at = s, start
            best.append(top)
            back.append(at)
        ids: list[int] = []
        end = len(word)
        while end:
            start = back[end]
            piece = pieces.id.get(word[start:end])
            ids += reversed(pieces.bytes_of(word[start:end])) if piece is None else [piece]
            end = start
        out.append(ids[::-1])
        before = word
    return out


def _table(path: str) -> tuple[TokenTable, Pieces]:
    return held(("pieces", path), lambda: _make_table(path))


def _make_table(path: str) -> tuple[TokenTable, Pieces]:
    pieces = Pieces(path)

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(new)), key=new.__getitem__)
        flat, lens = flat_ids(segment_sorted([new[i] for i in order], pieces))
        at = np.empty(len(new), np.int64)
        at[order] = np.arange(len(new))
        return flat[spans((np.cumsum(lens) - lens)[at], lens[at])], lens[at]

    return TokenTable(encode, 200_000), pieces


def marked_words(text: str) -> list[str]:
    if not text:
        return []
    return _WORD.findall(MARK + text.replace(MARK, _LITERAL).replace(" ", MARK))


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids per text)."""
    table, _ = _table(path)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a, b in blocks(texts):
        words = [marked_words(t) if t else [] for t in texts[a:b]]
        n = np.fromiter(map(len, words), np.int64, b - a)
        rows = table.rows([w for ws in words for w in ws])
        ids.append(table.ids(rows))
        counts.append(np.bincount(np.repeat(np.arange(b - a), n), table.len[rows], b - a).astype(np.int64))
    return np.concatenate(ids), np.concatenate(counts)


def decode_ids(flat: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """UTF-8 bytes of each text: its ids' bytes without the space put before it."""
    _, p = _table(path)
    data = p.bytes[spans(p.byte_at[flat], p.byte_len[flat])]
    of = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(np.bincount(of, p.byte_len[flat], len(counts)).astype(np.int64))
    return [data[a + 1 : b].tobytes() if b > a else b"" for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks(texts, 8 << 20):
            flat, n = encode_texts(texts[a:b], path)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id, ids: array<int>)``, one row per row of ``docs``."""
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.transform(in_batches).mapInArrow(lambda it: _encode(it, path), "id long, ids array<int>").withColumnRenamed("id", id_col)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at).astype(np.int64)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, n = _lists(batch.column(1))
        texts = [t.decode("utf-8", "surrogatepass") for t in decode_ids(flat, n, path)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``(id, text)`` of encoded rows; null ids decode to the empty text."""
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    d = coded.select(F.col(id_col).cast("long").alias("id"), ids.alias("ids"))
    return d.transform(in_batches).mapInArrow(lambda it: _decode(it, path), "id long, text string").withColumnRenamed("id", id_col)


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks(texts, 8 << 20):
            flat, n = encode_texts(texts[a:b], path)
            back = decode_ids(flat, n, path)
            le, ends = flat.astype("<u4"), np.cumsum(n)
            is_byte = np.concatenate([[0], np.cumsum(_table(path)[1].is_byte[flat])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(is_byte[ends] - is_byte[ends - n]),
                 pa.array([zlib.crc32(le[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64()),
                 pa.array([zlib.crc32(t) for t in back], pa.int64()),
                 pa.array([t == (s or "").encode("utf-8", "surrogatepass") for t, s in zip(back, texts[a:b])])],
                names=["id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "exact"])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Digests of the ids, and of the text decoded from them, per row of ``docs``."""
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.transform(in_batches).mapInArrow(lambda it: _digest(it, path), "id long, n_pieces long, n_byte_pieces long, ids_crc32 long, "
                        "decoded_crc32 long, exact boolean").withColumnRenamed("id", id_col)
