"""Helpers shared by the text operators.

Operators get ``(id, text)`` frames and select only the columns they name, so
extra columns with clashing names never reach them.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds at once besides a single long text.
BLOCK_BYTES = 1 << 20
#: ``[\x20\x09-\x0D]``: what ``bytes.split`` splits on, so words are ``[^\x20\x09-\x0D]+``.
WHITE = b" \t\n\r\x0b\x0c"
#: A-Z to a-z, every other ASCII byte outside ``[0-9a-z]`` to a space; bytes from 0x80 stay.
ALNUM_LOWER = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, shared by driver and executors.

    Only a session on one machine (tests) gets a folder of its own where
    ``spark.checkpoint.dir`` is unset; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (never localCheckpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a measured table of a few short columns is broadcast (some tens of megabytes).
BROADCAST_ROWS = 500_000


def measured_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised join side whose rows are counted: broadcast up to ``limit`` rows, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


#: Words of 64 bits in the filter of a join side that is too large for a broadcast: four megabytes of bits.
FILTER_WORDS = 1 << 19


def rows_of(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``df`` joined with a materialised ``side`` on a whole-number ``key``, without a shuffle of rows
    that have no partner: a counted side of up to ``BROADCAST_ROWS`` rows is broadcast; of a larger one,
    a bitmap of its keys' hashes, bounded whatever the side, lets go most rows before the shuffle."""
    if side.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), key)
    word = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - (FILTER_WORDS.bit_length() - 1))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")
    words = side.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    some = df.withColumn("_at", word).join(F.broadcast(cut(words)), F.col("_at") == F.col("_word")).filter(F.col("_bits").bitwiseAND(bit) != 0)
    return some.drop("_at", "_word", "_bits").join(side, key)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of steps whose results are cut or collected go now, not when the driver happens
    to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch: with texts of some kilobytes, a batch is some megabytes.
BATCH_ROWS = 1000


def in_batches(df: DataFrame) -> DataFrame:
    """Before ``mapInArrow``: bounds a batch where the session has Spark's default of 10,000 rows,
    of which a worker would hold tens of megabytes at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def text_column(df: DataFrame, text: str | tuple[str, str]) -> Callable[[pa.RecordBatch], pa.Array]:
    """Finds the texts in a batch of ``df``: a column, or (struct column, field)."""
    if isinstance(text, str):
        at = df.columns.index(text)
        return lambda batch: batch.column(at)
    at, field = df.columns.index(text[0]), text[1]
    return lambda batch: batch.column(at).field(field)


def whole_rows(df: DataFrame, *more: Column) -> DataFrame:
    """``df`` as one struct column ``row``, which clashes with no result's name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """A worker's one large memo; an operator that asks for its own lets the one before go."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of the worker's memo and gives freed memory back to the system: workers serve many
    operators, one after the other."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated index ranges ``start .. start+len`` of every row."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total, dtype=np.int64)


class _Index(dict):
    """Numbers words as they are first asked for; ``new`` collects them."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class TokenTable:
    """Token ids of distinct words, encoded once and read by row number.

    It is a worker's memo of bounded size: when it holds ``capacity`` words or
    ``capacity * 8`` ids it starts again, which costs time and changes no result.
    ``encode`` takes distinct words and returns their ids one after the other, and
    the number of ids of each.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], capacity: int = 600_000):
        self.encode, self.capacity = encode, capacity
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.start = np.zeros(1 << 12, np.int64)
        self.len = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    def rows(self, words: list) -> np.ndarray:
        """The row of each word; new words are encoded together.  Rows hold until the next call."""
        if len(self.index) > self.capacity or self.used > self.capacity * 8:
            self.reset()
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            flat, lens = self.encode(new)
            n, total = len(self.index) - len(new), len(flat)
            self.start, self.len = _room(self.start, n, len(new)), _room(self.len, n, len(new))
            self.flat = _room(self.flat, self.used, total)
            self.start[n : n + len(new)] = self.used + np.cumsum(lens) - lens
            self.len[n : n + len(new)] = lens
            self.flat[self.used : self.used + total] = flat
            self.used += total
            self.index.new = []
        return rows

    def ids(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.start[rows], self.len[rows])]


def flat_ids(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lens.sum())), lens


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(a):
        return a
    b = np.zeros(max(2 * len(a), used + more), a.dtype)
    b[:used] = a[:used]
    return b


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` overrides the installed package's place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
