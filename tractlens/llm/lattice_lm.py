"""LM scoring: marginal likelihood of texts over the lattice of their subword segmentations.

*Model.*  A text is a row of tokens: its words (runs of anything but white space, A-Z
lower-cased) and one end.  At each token it ends with probability ``p_end``, learned from
the training documents as (documents + 1) / (tokens + 2).  Otherwise a word follows: a word
of the training documents as one arc, or any word spelt by pieces of a public vocabulary,
independent of each other.  The arc of a word with c of N training words weighs (c - D) / N,
and the D that each of V distinct words gives up, D V / N in all, is the share of the
spellings (absolute discounting; D = (n1 + 1) / (n1 + 2 n2 + 2), with n1 and n2 words that
occur once and twice).  A word's probability is the sum, over *all* its ways through the
lattice, of the product of the arcs.  The forward recursion computes it in log space: the log
weight of a prefix is the log-sum-exp, over the pieces that end there, of the weight before
the piece plus its score.

*Scores* of pieces start as the vocabulary's own; a file of merge ranks has none, and piece
number r gets the Zipf weight 1 / (r + 1), as in ``viterbi_pieces``.  They are normalised
over the vocabulary and 256 bytes, each of which weighs as much as the least piece.  A
character that no piece covers (and U+2581, the word mark) is spelt by its bytes.  ``ROUNDS``
rounds of expectation-maximisation fit them to the distinct words of the training documents
(each of which gives up one D): the expected uses of each piece over all segmentations, and
``STRENGTH`` uses dealt out by the first scores, make the next ones.

*Base.*  Besides, every text gets the add-one unigram score of the corpus' own words:
the sum over its tokens of log10((c + 1) / (N + V + 1)), with c, N and V of the training
documents, which are those with crc32(id as text) % 7 != 2.

*Plan.*  One pass counts the words per task; after the shuffle each distinct word of the
corpus is there once, and its lattice is summed there, in sorted order, so that words share
the forward weights of a common prefix: once a round, in which a task hands on one number for
each piece of the vocabulary, and once for the words' weights.  Some thousand words are summed
at once: the recursion goes over the prefixes' lengths, and takes all arcs of a length together.  The second pass counts each document's
words.  Words that make up ``1 / hot`` of all tokens or more are at most ``hot`` words, of
at most ``hot`` times the mean length: they are broadcast, and their part of a document's
sums is taken at once.  The others, none of which holds more than that share, meet the
table by a join on the word.  No word, however frequent, gathers its occurrences in a task.

Edge cases: null and empty texts have the end only; a row without an id is never learned
from, and counts as held out; repeated rows are scored, and learned from, as often as they
come; texts of any length are scored whole, and so are words; without training documents
c, N and V are 0, and words are spelt by the vocabulary's own scores; an empty table gives an empty table.  Only ``id_col`` and ``text_col`` are
read, so columns with clashing names do no harm.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tractlens.llm.common import cut, held, in_batches, raw_bytes, vocabulary_path
from tractlens.llm.viterbi_pieces import _LITERAL, MARK, Pieces

LN10 = math.log(10.0)
#: The end of a text among the counted words, of which none holds a space.
END = b" "
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split at once, and distinct words that a task counts before it hands them on.
CHUNK, COUNTED = 1 << 20, 200_000
#: Rounds that fit the pieces' scores, and the uses that the first scores count for.
ROUNDS, STRENGTH = 3, 1000.0
#: Characters of words whose lattices are summed at once, padded to the longest of them.
CELLS = 1 << 17
#: With fewer prefixes of a length than this on average, the recursion goes prefix by prefix.
NARROW = 8


class Suffixes:
    """The trie of the pieces read from their ends, in arrays.

    An edge is ``node * classes + class of the character``; in their sorted order, edge number
    i leads to node i + 1.  ``piece`` is the number of the piece that a node stands for, or -1."""

    def __init__(self, pieces: Iterable[str]):
        root: dict = {}
        for i, piece in enumerate(pieces):
            node = root
            for c in reversed(piece):
                node = node.setdefault(ord(c), {})
            node[-1] = i
        level, nodes = [root], [root]
        while level:
            level = [child for node in level for c, child in sorted(node.items()) if c >= 0]
            nodes += level
        letters = sorted({c for node in nodes for c in node if c >= 0})
        #: Characters of no piece are of class 0, which no edge has.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.classes = len(letters) + 1
        self.piece = np.array([node.get(-1, -1) for node in nodes], np.int64)
        self.edges = np.array([i * self.classes + self.letter[c] for i, node in enumerate(nodes) for c in sorted(node) if c >= 0], np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the edges lead, and which of them there are."""
        edge = node * self.classes + letter
        at = np.searchsorted(self.edges, edge)
        return at + 1, self.edges[np.minimum(at, len(self.edges) - 1)] == edge


class Words:
    """The lattice of marked words: a node for each prefix, and the arcs that end there.

    Words next to each other share the nodes of their common prefix, so sorted ones have the
    fewest.  Nodes go by the length of the prefix, arcs by the node where they end; an arc of
    bytes has the piece number after the last."""

    def __init__(self, words: list[str], suffixes: Suffixes, n_pieces: int):
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        longest = int(size.max(initial=0))
        there = np.arange(longest)[:, None] < size
        char = np.zeros((longest, n), np.uint32)
        char.T[there.T] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        new = there.copy()
        new[:, 1:] &= ~np.logical_and.accumulate((char[:, 1:] == char[:, :-1]) & there[:, :-1], axis=0)
        # node[i, w]: the node of the first i characters of word w.
        node = np.zeros((longest + 1, n), np.int64)
        node[1:] = np.cumsum(new.ravel()).reshape(new.shape)
        cell, node, char = np.flatnonzero(new), node.ravel(), char.ravel()
        self.last = node[size * n + np.arange(n)]
        letter = suffixes.letter[char]
        live, end, state = cell, np.arange(1, len(cell) + 1), np.zeros(len(cell), np.int64)
        arcs = []
        while len(live):
            state, found = suffixes.step(state, letter[live])
            piece = np.where(found, suffixes.piece[np.where(found, state, 0)], -1)
            if not arcs:
                c = char[live]
                spelt = np.where(piece < 0, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 0)
                at = np.flatnonzero(spelt)
                arcs.append((node[live[at]], end[at], np.full(len(at), n_pieces), spelt[at]))
            at = np.flatnonzero(piece >= 0)
            arcs.append((node[live[at]], end[at], piece[at], np.ones(len(at), np.int64)))
            at = np.flatnonzero(found & (live >= n))
            live, end, state = live[at] - n, end[at], state[at]
        start, end, piece, times = (np.concatenate(x) for x in zip(*arcs)) if arcs else np.zeros((4, 0), np.int64)
        order = np.argsort(end, kind="stable")
        self.start, self.end, self.piece, self.times = start[order], end[order], piece[order], times[order]
        self.ways = np.bincount(end, minlength=len(cell) + 1)
        #: The first arc of each node, and the first node of each length.
        self.first = np.cumsum(self.ways) - self.ways
        self.level = 1 + np.concatenate([[0], np.cumsum(new.sum(axis=1))])
        #: A few words of great length: arrays of a length's arcs would hold too little.
        self.narrow = len(cell) < NARROW * longest

    def _levels(self) -> list[tuple[slice, slice]]:
        first = [*self.first.tolist(), len(self.start)]
        return [(slice(a, b), slice(first[a], first[b])) for a, b in zip(self.level.tolist(), self.level[1:].tolist())]

    def forward(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's log weight, and each arc's share of the ways to its end."""
        weight, share, scores = np.zeros(len(self.ways)), np.empty(len(self.start)), score[self.piece] * self.times
        if self.narrow:
            return self._forward_by_node(scores)
        for nodes, arcs in self._levels():
            first, ways = self.first[nodes] - arcs.start, self.ways[nodes]
            found = weight[self.start[arcs]] + scores[arcs]
            top = np.maximum.reduceat(found, first)
            parts = np.exp(found - np.repeat(top, ways))
            sums = np.add.reduceat(parts, first)
            weight[nodes] = top + np.log(sums)
            share[arcs] = parts / np.repeat(sums, ways)
        return weight, share

    def _forward_by_node(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exp, weight, share = math.exp, [0.0], array("d")
        starts, scores, first = self.start.tolist(), scores.tolist(), [*self.first.tolist(), len(self.start)]
        for a, b in zip(first[1:], first[2:]):
            found = [weight[s] + c for s, c in zip(starts[a:b], scores[a:b])]
            top = max(found)
            parts = [exp(f - top) for f in found]
            total = sum(parts)
            weight.append(top + math.log(total))
            share.extend([p / total for p in parts])
        return np.array(weight), np.array(share)

    def uses(self, score: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations; those of bytes come last.

        ``reach`` is how often the words, as expected, pass a node; from the longest prefixes
        on, a node's ways are dealt out to the nodes where its last pieces begin."""
        _, share = self.forward(score)
        reach = np.bincount(self.last, minlength=len(self.ways)).astype(float)
        if self.narrow:
            flow, reach = share.tolist(), reach.tolist()
            for a, (start, end) in reversed([*enumerate(zip(self.start.tolist(), self.end.tolist()))]):
                flow[a] *= reach[end]
                reach[start] += flow[a]
            share = np.array(flow)
        else:
            for _, arcs in reversed(self._levels()):
                share[arcs] *= reach[self.end[arcs]]
                np.add.at(reach, self.start[arcs], share[arcs])
        return np.bincount(self.piece, share * self.times, minlength=len(score))


class Lattice:
    """Normalised log scores of the pieces and, last, of a byte.  ``uses`` of them are added to
    the first scores' ``STRENGTH``."""

    def __init__(self, pieces: Pieces):
        self.suffixes = Suffixes(pieces.score)
        score = np.fromiter(pieces.score.values(), float, len(pieces.score))
        least, top = score.min(), score.max()
        norm = top + math.log(math.fsum(np.exp(score - top)) + 256 * math.exp(least - top))
        self.chance = np.exp(np.append(score, least) - norm)

    def scores(self, uses: np.ndarray | None = None) -> np.ndarray:
        each = np.zeros(len(self.chance)) if uses is None else np.append(uses[:-1], uses[-1] / 256)
        return np.log(each + STRENGTH * self.chance) - math.log(STRENGTH + (0.0 if uses is None else math.fsum(uses)))

    def words(self, words: Iterable[str]) -> Iterator[Words]:
        """The lattices of some words at once, of at most ``CELLS`` characters if padded, or of one word."""
        some: list[str] = []
        longest = 0
        for word in words:
            longest = max(longest, len(word))
            if some and (len(some) + 1) * longest > CELLS:
                yield Words(some, self.suffixes, len(self.chance) - 1)
                some, longest = [], len(word)
            some.append(word)
        if some:
            yield Words(some, self.suffixes, len(self.chance) - 1)

    def sorted_words(self, words: Iterable[str], uses: np.ndarray | None = None) -> np.ndarray:
        """Log marginal probability of each marked word; sorted words share their prefixes' weights."""
        score = self.scores(uses)
        return np.concatenate([w.forward(score)[0][w.last] for w in self.words(words)] or [np.zeros(0)])

    def uses(self, words: Iterable[str], uses: np.ndarray | None = None) -> np.ndarray:
        """Expected uses of each piece, and of bytes, over all segmentations of the sorted marked words."""
        score, out = self.scores(uses), np.zeros(len(self.chance))
        for w in self.words(words):
            out += w.uses(score)
        return out


def marked(word: bytes) -> str:
    return MARK + word.decode("utf-8", "surrogateescape").replace(MARK, _LITERAL)


def held_out(id_col: str) -> Column:
    """True for rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(True))


def _split(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, at most about ``CHUNK`` bytes of them at once."""
    at = 0
    while at < len(text):
        edge = _WHITE.search(text, at + CHUNK)
        end = edge.end() if edge else len(text)
        yield text[at:end].translate(_LOWER).split()
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, its places in training texts, in all texts), counted over the task; a word has two rows
    at most each time that counts are handed on."""
    learned, other = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        n = [*learned.values(), *other.values()]
        out = pa.RecordBatch.from_arrays(
            [pa.array([*learned, *other], pa.binary()), pa.array([*learned.values(), *repeat(0, len(other))], pa.int64()),
             pa.array(n, pa.int64())], names=["word", "c", "n"])
        learned.clear(), other.clear()
        return out

    for batch in batches:
        for text, out in zip(raw_bytes(batch.column(1)), batch.column(0).to_pylist()):
            seen = other if out else learned
            seen[END] += 1
            for words in _split(text or b""):
                seen.update(words)
                if len(learned) + len(other) > COUNTED:
                    yield rows()
    yield rows()


def _lattice(path: str) -> Lattice:
    return held(("lattice", path), lambda: Lattice(Pieces(path)))


def _uses(batches: Iterable[pa.RecordBatch], path: str, uses: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """The task's words, which come sorted, give a row for each piece that they use."""
    out = _lattice(path).uses((marked(w) for batch in batches for w in batch.column(0).to_pylist()), uses and uses.value)
    used = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(out[used], pa.float64())], names=["piece", "n"])


def _fitted(words: DataFrame, path: str) -> Broadcast | None:
    """The broadcast uses of pieces, in the vocabulary's order, after ``ROUNDS`` rounds over distinct ``(word)`` rows."""
    uses, size = None, len(Pieces(path).score) + 1
    for _ in range(ROUNDS):
        # At most a row for each piece of the vocabulary comes to the driver.
        rows = words.transform(in_batches).mapInArrow(lambda it, u=uses: _uses(it, path, u), "piece long, n double").groupBy("piece").agg(
            F.sum("n").alias("n")).toArrow()
        n = np.zeros(size)
        n[rows.column("piece").to_numpy()] = rows.column("n").to_numpy()
        uses = words.sparkSession.sparkContext.broadcast(n)
    return uses


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``CHUNK`` bytes."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.nbytes for b in some) >= CHUNK:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def _weigh(batches: Iterable[pa.RecordBatch], path: str, uses: Broadcast | None, discount: float, spelt: float, total: int) -> Iterator[pa.RecordBatch]:
    lattice = _lattice(path)
    for batch in _together(batches):
        weight = lattice.sorted_words((marked(w) if w != END else "" for w in batch.column(0).to_pylist()), uses and uses.value)
        if total:
            c = batch.column(1).to_numpy()
            arc = np.log(np.where(c > 0, c - discount, 1.0) / total)
            weight = np.where(c > 0, np.logaddexp(arc, weight + math.log(spelt)), weight + math.log(spelt))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=["word", "c", "n", "weight"])


def word_table(docs: DataFrame, path: str) -> tuple[DataFrame, Row]:
    """``(word, c, n, weight)`` of every distinct word of ``(out, text)`` rows, and of the end; and
    a row of the training documents' ``tokens``, ``distinct`` and ``ends``."""
    counted = (docs.select("out", "text").transform(in_batches).mapInArrow(_count, "word binary, c long, n long")
               .groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    # Sorting lays the words out as a trie; it only saves time.
    counted = cut(counted.sortWithinPartitions("word"))
    c, end = F.col("c"), F.col("word") == F.lit(bytearray(END))
    learned = counted.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count_if(c > 0).alias("distinct"),
        F.coalesce(F.max(F.when(end, c)), F.lit(0)).alias("ends"), F.count_if((c == 1) & ~end).alias("once"),
        F.count_if((c == 2) & ~end).alias("twice")).first()
    total, distinct = learned["tokens"] - learned["ends"], learned["distinct"] - (learned["ends"] > 0)
    discount = (learned["once"] + 1) / (learned["once"] + 2 * learned["twice"] + 2)
    spelt = discount * distinct / total if total else 1.0
    fitted = _fitted(counted.filter((c > 0) & ~end).select("word"), path)
    weighed = counted.transform(in_batches).mapInArrow(
        lambda it: _weigh(it, path, fitted, discount, spelt, total), "word binary, c long, n long, weight double")
    return cut(weighed), learned


def _sum(batches: Iterable[pa.RecordBatch], table: Callable[[], tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Per document one row with its frequent words' sums, and one row per rare word.

    The former's ``word`` begins with a space, so that it meets no word of the table."""
    index, log_c, known, weight = table()
    names = ("uid", "id", "out", "n_tokens", "n_known", "base", "lattice", "word", "n")
    kinds = (pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())
    done: list[tuple] = []
    #: Of rare words: document, word, places.
    rare: tuple[list, list, list] = ([], [], [])

    def rows() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done)] or [[] for _ in names[:-1]]
        more = {"uid": rare[0], "word": rare[1], "n": rare[2]}
        columns = [c + more.get(name, [None] * len(rare[0])) for name, c in zip(names, [*columns, [None] * len(done)])]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))
        done.clear()
        for column in rare:
            column.clear()
        return out

    for batch in batches:
        uids, ids, outs = (batch.column(i).to_pylist() for i in range(3))
        for uid, doc_id, out, text in zip(uids, ids, outs, raw_bytes(batch.column(3))):
            seen: Counter = Counter()
            for words in _split(text or b""):
                seen.update(words)
            n = np.fromiter(seen.values(), np.int64, len(seen))
            at = np.fromiter(map(index.get, seen, repeat(-1)), np.int64, len(seen))
            often = at >= 0
            a, k = at[often], n[often]
            done.append((uid, doc_id, out, int(n.sum()) + 1, int(k[known[a]].sum()), float(k @ log_c[a]), float(k @ weight[a]),
                         END + uid.to_bytes(8, "little")))
            seldom = ~often
            rare[1].extend(compress(seen, seldom.tolist()))
            rare[2].extend(n[seldom].tolist())
            rare[0].extend([uid] * (len(rare[1]) - len(rare[0])))
            if len(rare[0]) > 20_000:
                yield rows()
    yield rows()


def _frequent(table: DataFrame, hot: int) -> Callable[[], tuple]:
    """Words with ``1 / hot`` of all tokens or more, at most ``hot`` of them, as a broadcast lookup."""
    total = table.agg(F.sum("n")).first()[0] or 0
    rows = table.filter((F.col("n") * hot >= total) & (F.col("word") != F.lit(bytearray(END)))).select("word", "c", "weight").toArrow()
    c = rows.column("c").to_numpy()
    sent = table.sparkSession.sparkContext.broadcast(
        (rows.column("word").to_pylist(), np.log10(c + 1.0), c > 0, rows.column("weight").to_numpy()))

    def get() -> tuple:
        words, *columns = sent.value
        return {w: i for i, w in enumerate(words)}, *columns

    return get


def lattice_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                   hot: int = 1 << 18) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``."""
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    d = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("out"), F.col(text_col).alias("text"))
    table, learned = word_table(d, path)
    tokens, distinct, ends = learned["tokens"], learned["distinct"], learned["ends"]
    p_end = (ends + 1) / (tokens + 2)

    get, id_type = _frequent(table, hot), to_arrow_type(d.schema["id"].dataType)
    kind = d.schema["id"].dataType.simpleString()
    summed = d.select(F.monotonically_increasing_id().alias("uid"), "id", "out", "text").transform(in_batches).mapInArrow(
        lambda it: _sum(it, get, id_type), f"uid long, id {kind}, out boolean, n_tokens long, n_known long, base double, "
                                           "lattice double, word binary, n long")
    per_doc = summed.join(table.select("word", "c", "weight"), "word", "left").groupBy("uid").agg(
        F.max("id").alias("id"), F.max("out").alias("out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("n")))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("n") * F.log10(F.col("c") + 1.0))).alias("base"),
        F.sum(F.coalesce("lattice", F.col("n") * F.col("weight"))).alias("lattice"))
    return per_doc.select(
        F.col("id").alias(id_col), F.col("out").alias("held_out"), "n_tokens",
        (F.coalesce("n_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"),
        ((F.col("lattice") + (F.col("n_tokens") - 1) * F.lit(math.log1p(-p_end)) + F.lit(math.log(p_end))) / F.lit(LN10)).alias("score"))
