"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters.

``write_tokens`` sorts documents by id over range partitions (a hot id range is
split by a hash of the text), encodes each text once, and writes one ORC file per
partition: ids ascend within and across files, stripes hold run-length encoded
``ids`` lists, row groups carry min/max indexes, and ``doc_id`` has a Bloom filter.
Readers open stripes in parallel; a filter on ``doc_id`` skips files, stripes and
row groups by metadata.  ``before`` counts the ids
before a document in its file; its place in the whole corpus adds the totals of the files
before, of which there is one row per file.

Texts are encoded by the ``tokenizers`` library in units: a text without two
adjacent white-space characters is cut before every space and line feed, where a
byte-level BPE pre-tokeniser always cuts too, so that distinct units are encoded
once per worker; any other text is one unit.  The ids equal those of the whole text.

Edge cases: null text is empty (the end id alone); null ids sort first; equal ids
keep one row each, ordered by text; special-token strings in texts are ordinary
text; texts of any length are encoded whole; an empty table writes no rows and reads back as an
empty table.  Only id and text are read, so columns with clashing names do no harm.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractlens.llm.common import (
    TokenTable, blocks, flat_ids, held, shared_dir, shuffle_partitions, spans, vocabulary_path,
)

_TWO_SPACES = re.compile(r"\s\s")
#: Bytes of text whose new units are encoded together: the library is faster on more of them.
ENCODE_BYTES = 2 << 20
#: Marks a unit that begins its text; no later unit begins with two line feeds.
_FIRST = "\n\n"


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def units(text: str) -> list[str]:
    """Parts of a text that are encoded on their own; their ids in order are the text's."""
    if _TWO_SPACES.search(text):
        return [_FIRST + text]
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = _FIRST + parts[0]
    return parts


def _table(path: str) -> TokenTable:
    return held(("byte_bpe", path), lambda: _make_table(path))


def _make_table(path: str) -> TokenTable:
    t = _tokenizer(path)
    # A token of a byte-level vocabulary has one character per byte of text.
    size = np.zeros(t.get_vocab_size(), np.int64)
    for token, i in t.get_vocab().items():
        size[i] = len(token)

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that may follow each other in a text are encoded as one, and cut by their bytes."""
        alone, joined, joins = [], [], np.ones(len(new), bool)
        for i, u in enumerate(new):
            if u[:2] == _FIRST:
                alone.append(u[2:])
                joins[i] = False
            elif not u or u[-1].isspace():
                alone.append(u if u[:1] == "\n" else " " + u)
                joins[i] = False
            else:
                joined.append(u if u[0] == "\n" else " " + u)
        flat, lens = flat_ids([e.ids for e in t.encode_batch_fast(alone, add_special_tokens=False)])
        texts = ["".join(joined[i : i + 256]) for i in range(0, len(joined), 256)]
        more, _ = flat_ids([e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, joined)), np.int64, len(joined)))
        cuts = np.searchsorted(np.cumsum(size[more]), ends, side="right")
        n = np.zeros(len(new), np.int64)
        n[~joins], n[joins] = lens, np.diff(cuts, prepend=0)
        start = np.zeros(len(new), np.int64)
        start[~joins], start[joins] = np.cumsum(lens) - lens, len(flat) + cuts - n[joins]
        return np.concatenate([flat, more])[spans(start, n)], n

    return TokenTable(encode)


def encode_texts(texts: list[str | None], path: str, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with the end id after each, ids per text)."""
    table, ids, counts = _table(path), [], []
    for a, b in blocks(texts, ENCODE_BYTES):
        parts = [units(t) if t else [] for t in texts[a:b]]
        per = np.fromiter(map(len, parts), np.int64, b - a)
        rows = table.rows(list(chain.from_iterable(parts)))
        n = np.bincount(np.repeat(np.arange(b - a), per), table.len[rows], b - a).astype(np.int64)
        out = np.full(int(n.sum()) + b - a, end_id, np.int32)
        out[spans(np.cumsum(n + 1) - (n + 1), n)] = table.ids(rows)
        ids.append(out)
        counts.append(n + 1)
    return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One call is one file: rows are numbered, and count the ids before them, within it."""
    row = before = 0
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in blocks(texts, 8 << 20):
            flat, n = encode_texts(texts[a:b], path, end_id)
            ends = np.cumsum(n)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(before + ends - n),
                 pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["row", "doc_id", "before", "n_tokens", "ids"])
            row, before = row + b - a, before + int(n.sum())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, partitions: int | None = None, stripe_bytes: int = 16 << 20,
                 index_stride: int = 2000, compress: str = "zstd") -> None:
    """Writes ``(shard, row, doc_id, before, n_tokens, ids)`` to ``path``."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange(partitions or shuffle_partitions(spark), "doc_id", "tie")
    d = d.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    coded = d.mapInArrow(lambda it: _encode(it, tokenizer, end_id),
                         "row long, doc_id long, before long, n_tokens long, ids array<int>")
    coded = coded.select(F.spark_partition_id().alias("shard"), "*")
    (coded.write.mode("errorifexists").option("compression", compress)
     .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(index_stride))
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, row, doc_id, before, n_tokens, ids)``; filters on ``doc_id`` are pushed to the files' metadata."""
    return spark.read.schema(
        "shard int, row long, doc_id long, before long, n_tokens long, ids array<int>").orc(path)


def shard_starts(tokens: DataFrame) -> DataFrame:
    """``(shard, shard_start)``: ids of all files before; one row per file, a listing of the output."""
    files = tokens.groupBy("shard").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shard_start"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy().tolist()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
        n = [b - a for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("doc_id"), batch.column("before"), pa.array(n, pa.int64()),
             pa.array(crc, pa.int64())], names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files alone."""
    tokens = read_tokens(spark, path)
    crc = tokens.select("shard", "doc_id", "before", "ids").mapInArrow(
        _crc, "shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return crc.join(shard_starts(tokens), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
