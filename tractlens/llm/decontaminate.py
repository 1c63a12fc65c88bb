"""Benchmark decontamination with an FM-index per shard of training text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window
is ``width`` consecutive words of a benchmark item, or a shorter item whole.  Each task
indexes its partition's documents shard by shard (``shard_words`` words, or one longer
document, however the rows come in batches): the alphabet is the windows' vocabulary, any
other word separates, and a stretch between separators that is shorter than the shortest
window is left out, since no window fits into it.  All windows are searched backward at
once through the wavelet matrix, located by sampled suffix positions, and their places
merged to removal spans.

The benchmark is the stated query set.  Its size is measured; beyond ``block_chars``
characters it is searched in blocks, one after the other: the driver and each task hold one
block, whose hits (of the texts that have any, by the texts' hash) are written to the shared
folder before the next one is read, and are merged to the documents at the end.

Edge cases: null and empty texts have no words and are clean; items without words have
no window; equal items all count; windows of items without an id hit words and name no item;
repeated document ids give one row each; an empty benchmark leaves every document clean; an
empty table gives an empty table.  Only the named columns are read, and ``keep_rows`` carries
the others in one struct, so columns with clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import ALNUM_LOWER, cut, in_batches, measured_side, raw_bytes, release, schema_of, spans, text_column, whole_rows
from tractlens.llm.fm_index import FMIndex

FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Windows:
    """Distinct windows of items, as symbols, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in text.translate(ALNUM_LOWER).split()]
            for i in range(max(1, len(w) - width + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + width]), set()).add(item)
        self.lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        self.items = list(windows.values())
        self.patterns = np.zeros((len(windows), width), np.int32)
        for k, w in enumerate(windows):
            self.patterns[k, width - len(w) :] = w
        self.least = int(self.lengths.min()) if windows else 0

    def find(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position in ``symbols``) of every occurrence; 0 separates."""
        edge = np.flatnonzero(np.diff((symbols > 0).astype(np.int8), prepend=0, append=0))
        start, length = edge[::2], edge[1::2] - edge[::2]
        keep = length >= self.least
        start, length = start[keep], length[keep]
        if not self.least or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Each stretch is followed by one separator.
        source = spans(start, length + 1)
        text = np.where(source < len(symbols), symbols[np.minimum(source, len(symbols) - 1)], 0)
        text[np.cumsum(length + 1) - 1] = 0
        index = FMIndex(text.astype(np.int32), len(self.ids))
        which, at = index.locate(*index.search(self.patterns, self.lengths))
        return which, source[at]


def _shards(batches: Iterator[pa.RecordBatch], texts_of: Callable, ids: dict[bytes, int], shard_words: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, symbols of each text), filled up across batches."""
    rows: list[pa.RecordBatch] = []
    symbols: list[np.ndarray] = []
    size = 0

    def shard() -> tuple[pa.RecordBatch, list]:
        out = pa.Table.from_batches(rows).combine_chunks().to_batches()
        done = out[0] if len(out) == 1 else rows[0].slice(0, 0), list(symbols)
        rows.clear(), symbols.clear()
        return done

    for batch in batches:
        first = 0
        for i, text in enumerate(raw_bytes(texts_of(batch))):
            words = (text or b"").translate(ALNUM_LOWER).split()
            if size and size + len(words) > shard_words:
                rows.append(batch.slice(first, i - first))
                yield shard()
                first, size = i, 0
            symbols.append(np.fromiter((ids.get(w, 0) for w in words), np.int32, len(words)))
            size += len(words)
        rows.append(batch.slice(first))
    if symbols:
        yield shard()


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[str | None, bytes]], width: int, shard_words: int,
            texts_of: Callable) -> Iterator[pa.RecordBatch]:
    release()
    w = Windows(items, width)
    for rows, symbols in _shards(batches, texts_of, w.ids, shard_words):
        n = np.fromiter(map(len, symbols), np.int64, len(symbols))
        begin = np.cumsum(n + 1) - (n + 1)
        joined = np.zeros(int((n + 1).sum()), np.int32)
        joined[spans(begin, n)] = np.concatenate(symbols)
        which, at = w.find(joined)
        change = np.zeros(len(joined) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + w.lengths[which], -1)
        edge = np.flatnonzero(np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0))
        doc = np.searchsorted(begin, edge[::2], side="right") - 1
        found: dict[int, list] = {}
        for d, s, e in zip(doc.tolist(), (edge[::2] - begin[doc]).tolist(), (edge[1::2] - begin[doc]).tolist()):
            found.setdefault(d, []).append({"start": s, "end": e})
        names: dict[int, set] = {}
        pairs = np.unique((np.searchsorted(begin, at, side="right") - 1) * max(1, len(w.items)) + which)
        for d, k in zip((pairs // max(1, len(w.items))).tolist(), (pairs % max(1, len(w.items))).tolist()):
            names.setdefault(d, set()).update(w.items[k])
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(n), pa.array([found.get(i, []) for i in range(len(n))], _SPANS),
             pa.array([sorted(names.get(i, set()) - {None}) for i in range(len(n))], pa.list_(pa.string()))],
            names=[*rows.schema.names, "n_words", "spans", "items"])


def _items(part: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r["item"], r["text"].encode("utf-8", "surrogatepass")) for r in part.toLocalIterator()]


def find_spans(rows: DataFrame, benchmark: DataFrame, text: str | tuple[str, str], item_id: str = "item_id", item_text: str = "text",
               width: int = 13, block_chars: int = 4 << 20, shard_words: int = 1 << 20) -> DataFrame:
    """``rows`` (without columns named n_words, spans or items) with FOUND.

    ``spans`` are merged word ranges [start, end) inside occurring windows, ``items``
    the ids of items with an occurring window, sorted as strings.
    """
    b = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    chars = b.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    texts_of = text_column(rows, text)
    search = lambda items: _searcher(items, width, shard_words, texts_of)
    if n_blocks == 1:
        return rows.transform(in_batches).mapInArrow(search(_items(b)), f"{schema_of(rows)}, {FOUND}")

    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    at = F.col(text) if isinstance(text, str) else F.col(text[0])[text[1]]
    texts = rows.select(F.sha2(at, 256).alias("hash"), at.alias("text"))
    blocks_of = text_column(texts, "text")
    hits = None
    for k in range(n_blocks):
        found = texts.transform(in_batches).mapInArrow(_searcher(_items(b.filter(block == k)), width, shard_words, blocks_of),
                                                       f"{schema_of(texts)}, {FOUND}")
        own = cut(found.filter(F.size("spans") > 0).select("hash", "spans", "items").dropDuplicates(["hash"]))
        hits = own if hits is None else hits.unionByName(own)
    merged = hits.groupBy("hash").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    known = measured_side(cut(merged.select(F.col("hash").alias("_hash"), _union("spans").alias("spans"), "items")))
    counted = rows.transform(in_batches).mapInArrow(search([]), f"{schema_of(rows)}, {FOUND}").drop("spans", "items")
    return counted.join(known, F.sha2(at, 256) == F.col("_hash"), "left").drop("_hash").withColumns(
        {"spans": F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def _union(column: str) -> Column:
    """Sorted ranges, with those that overlap or touch joined."""
    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (r["start"] <= last["end"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))
    return F.aggregate(column, F.array().cast("array<struct<start:int,end:int>>"), add)


def _searcher(items: list[tuple[str | None, bytes]], width: int, shard_words: int, texts_of: Callable) -> Callable:
    return lambda it: _search(it, items, width, shard_words, texts_of)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated() -> Column:
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **search: object) -> DataFrame:
    """``(id, n_words, spans, items, n_hit, contaminated)``, one row per row of ``docs``."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    got = find_spans(d, benchmark, "text", **search)
    return got.select(F.col("id").alias(id_col), "n_words", "spans", "items", n_hit().alias("n_hit"),
                      contaminated().alias("contaminated"))


def keep_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **search: object) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    return find_spans(whole_rows(docs), benchmark, ("row", text_col), **search).filter(~contaminated()).select("row.*")
