"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation should read ``(system? (user assistant)+)?``.  Its rows are edited at least
cost: keep (0), give another role (2), delete (3; forced for blank and duplicate rows), and
put in an empty user or assistant row (2); a truncated row that stays costs 1.  Of the
cheapest edits, those whose initials (K, R, D, I in order) come first in ASCII are taken.

*Four states* (nothing yet, system, user, assistant) suffice: each row maps a vector of four
costs to another one.  Hirschberg's scheme meets in the middle: a forward vector from the
start and a backward vector from the end give, for each state, the cost of the best repair
that crosses the middle there; the best crossing is fixed, and both halves are repaired
alone.  Only vectors of four are held, so space is linear in the rows, with no table of
choices.  Ties: a forward vector also ranks its states by their best edits so far.  From
one start, edits that lead to different states differ, and none is a prefix of the other
(each ends by consuming the same row), so ranks carry over from row to row, and of
equally cheap crossings the one of the least rank belongs to the audit-least repair.

*Plan.*  Equal rows of a conversation's turn are one row with a count.  These narrow rows
(no texts) are range-partitioned by conversation and order, so that a conversation of any
length is cut into contiguous segments and no task gets it whole.  Each segment at a
partition's edge is summed up as a 4 x 4 cost and rank matrix; the scheme runs over these
(at most two for each partition) first and fixes the state at every partition edge, and each
task repairs its segments between fixed states.  Texts join the edits at the end, by a key
that is unique on both sides.

*Edge cases.*  Nulls: a null role or text is one space, a null turn sorts first, and null ids
are one conversation.  Ties in a turn are ordered by role, then text (its first 32
characters, then its hash); repeated rows are duplicates.  A role is judged by its first
character alone; an empty one fits no state.  A conversation of blank rows only is deleted
whole, which is well formed.  Texts of any length are kept whole; an empty table gives empty
tables.  Only the four named columns are read, so columns with clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tractlens.llm.common import cut, in_batches, shuffle_partitions

#: Costs and words of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"

#: States: nothing yet, system, user, assistant; what an added row leads to.
_AFTER_ADDED = (2, 2, 3, 2)
_LETTER = "sua"
#: Kinds of rows: as they should be, truncated, to be deleted.
FINE, CUT_OFF, GONE = 0, 1, 2
END = 12  # the step after the last row; 0..11 are 3 * initial + kind, initial 3 for all others
_NO = 1 << 60

Step = tuple[tuple[tuple[int, int, str], ...], ...]


def _steps(code: int) -> Step:
    """For each state before a row: (state after it, cost, edits), the best for each state after."""
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(to: int, cost: int, edits: str, best: dict[int, tuple[int, str]] = best) -> None:
            best[to] = min(best.get(to, (_NO, "")), (cost, edits))

        if code == END:
            added = (0, 2, 1, 0)[state]
            offer(0, added * INSERT, "I" * added)
        else:
            initial, kind = divmod(code, 3)
            at = state
            for added in range(3):
                so_far, edits = added * INSERT, "I" * added
                offer(at, so_far + DELETE, edits + "D")
                if kind != GONE:
                    stays = so_far + (TRUNCATED if kind == CUT_OFF else 0)
                    if (initial == 0 and at == 0) or (initial == 1 and at != 2) or (initial == 2 and at == 2):
                        offer(initial + 1, stays, edits + "K")
                    offer(_AFTER_ADDED[at], stays + REROLE, edits + "R")
                at = _AFTER_ADDED[at]
        out.append(tuple(sorted((to, c, e) for to, (c, e) in best.items())))
    return tuple(out)


STEPS: tuple[Step, ...] = tuple(map(_steps, range(END + 1)))

#: A vector: (cost, rank) by state.  A matrix: a vector for each state before.
Vector = list[tuple[int, int]]
Matrix = list[Vector]


def unit(state: int) -> Vector:
    return [(0, 0) if s == state else (_NO, 0) for s in range(4)]


def _ranked(found: list[tuple[int, object] | None]) -> Vector:
    """Costs with their edits' place in order, by state."""
    order = sorted(f[1] for f in found if f)
    return [(f[0], order.index(f[1])) if f else (_NO, 0) for f in found]


@lru_cache(maxsize=1 << 16)
def _forward(vector: tuple, code: int) -> tuple:
    found: list[tuple | None] = [None] * 4
    for (cost, rank), row in zip(vector, STEPS[code]):
        if cost < _NO:
            for to, more, edits in row:
                new = (cost + more, (rank, edits))
                if found[to] is None or new < found[to]:
                    found[to] = new
    return tuple(_ranked(found))


def forward(vector: Vector, codes: Sequence[int]) -> Vector:
    """The vector after the rows.  Steps are taken on costs above the least, so that equal ones are looked up."""
    base, now = 0, tuple(vector)
    for code in codes:
        least = min(c for c, _ in now)
        now, base = _forward(tuple((c - least if c < _NO else c, r) for c, r in now), code), base + least
    return [(c + base if c < _NO else c, r) for c, r in now]


def backward(costs: list[int], codes: Sequence[int]) -> list[int]:
    for code in reversed(codes):
        costs = [min((more + costs[to] for to, more, _ in row), default=_NO) for row in STEPS[code]]
        costs = [min(c, _NO) for c in costs]
    return costs


def crossing(before: Vector, after: list[int]) -> int:
    """The state of the cheapest repair through the middle, of equal ones the audit-least."""
    return min(range(4), key=lambda s: (before[s][0] + after[s], before[s][1]))


def _ends(end: int) -> list[int]:
    return [0 if s == end else _NO for s in range(4)]


def hirschberg(codes: Sequence[int], start: int, end: int) -> list[str]:
    """Edits of each row, for the audit-least cheapest repair between two states."""
    out: list[str] = []
    todo = [(0, len(codes), start, end)]
    while todo:
        a, b, s, t = todo.pop()
        if b - a == 1:
            out.append(next(edits for to, _, edits in STEPS[codes[a]][s] if to == t))
        elif b > a:
            middle = (a + b) // 2
            via = crossing(forward(unit(s), codes[a:middle]), backward(_ends(t), codes[middle:b]))
            todo += [(middle, b, via, t), (a, middle, s, via)]
    return out


def matrix(codes: Sequence[int]) -> Matrix:
    return [forward(unit(s), codes) for s in range(4)]


def through(vector: Vector, m: Matrix) -> Vector:
    """The vector after a segment that is summed up as a matrix."""
    found: list[tuple | None] = [None] * 4
    for (cost, rank), row in zip(vector, m):
        for to, (more, place) in enumerate(row):
            new = (cost + more, (rank, place))
            if cost + more < _NO and (found[to] is None or new < found[to]):
                found[to] = new
    return _ranked(found)


def segment_states(segments: list[Matrix], start: int, end: int) -> list[int]:
    """The states before, between and after segments, by the same scheme over their matrices."""
    states = {0: start, len(segments): end}
    todo = [(0, len(segments))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        middle = (a + b) // 2
        before = unit(states[a])
        for m in segments[a:middle]:
            before = through(before, m)
        after = _ends(states[b])
        for m in reversed(segments[middle:b]):
            after = [min(_NO, min(m[s][to][0] + after[to] for to in range(4))) for s in range(4)]
        states[middle] = crossing(before, after)
        todo += [(a, middle), (middle, b)]
    return [states[i] for i in range(len(segments) + 1)]


@lru_cache(maxsize=1 << 14)
def _short(codes: tuple[int, ...], start: int, end: int) -> list[str]:
    return hirschberg(codes, start, end)


def edits_of(codes: list[int], start: int, end: int) -> list[str]:
    return _short(tuple(codes), start, end) if len(codes) <= 24 else hirschberg(codes, start, end)


# Spark steps: narrow rows, edges of partitions, edits, texts

#: Columns of a narrow row, in order.
NARROW = ("conv", "turn", "role", "head", "hash", "copies", "blank", "cut_off", "first")
_PLACE = ("conv", "turn", "role", "head", "hash")
#: Narrow rows that a task holds at most, all of one conversation.
TASK_ROWS = 200_000


def _narrow(rows: DataFrame) -> DataFrame:
    """``NARROW`` columns of ``(conv, turn, role, text, copies)``: equal rows are one with a count
    (0: only the conversation's id is known by it)."""
    stripped = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    same = rows.select(
        "conv", "turn", "role", F.substring("text", 1, 32).alias("head"), F.sha2("text", 256).alias("hash"), "copies",
        (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut_off"),
    ).groupBy(*_PLACE, "blank", "cut_off").agg(F.sum("copies").cast("long").alias("copies"))
    # A role and text comes once for each turn by now, so its earliest row is known by its turn.
    earliest = same.filter("copies > 0").groupBy("conv", "role", "hash").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least")).select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), F.col("least.turn").alias("t"))
    return same.join(earliest, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
                     & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")), "left").select(
        *NARROW[:-1], F.col("h").isNotNull().alias("first"))


def _initial(role: str) -> str:
    return role[:1]


def _codes(row: tuple) -> list[int]:
    _, _, role, _, _, copies, blank, cut_off, first = row
    initial = 3 * (_LETTER.index(role[0]) if role and role[0] in _LETTER else 3)
    return [initial + (GONE if blank or not first else CUT_OFF if cut_off else FINE)] + [initial + GONE] * (copies - 1)


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, object, list[tuple]]]:
    """(number, conversation, rows) of the task's contiguous segments."""
    rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
    for number, (conv, group) in enumerate(groupby(rows, key=lambda r: r[0])):
        yield number, conv, list(group)


def _edges(batches: Iterable[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The task's first and last segment (or its only one), summed up."""
    part, ends = TaskContext.get().partitionId(), []
    for segment in _segments(batches):
        ends = [*ends[:1], segment]
    out = []
    for number, conv, rows in ends:
        codes = [c for r in rows for c in _codes(r)]
        flat = [x if x < _NO else -1 for row in matrix(codes) for pair in row for x in pair]
        out.append((part, number, number == 0, number == ends[-1][0], conv, flat, _initial(rows[-1][2])))
    if out:
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), conv_type, pa.list_(pa.int64()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                         names=["part", "number", "first", "last", "conv", "matrix", "tail"])


Fixed = dict[tuple[int, int], tuple[int, "int | None", "str | None"]]


def _fix_edges(edges: list) -> Fixed:
    """Of every segment that goes on in another partition: its state before, its state after (None
    where the conversation ends), and the initial of the row before it."""
    chains: list[list] = []
    for e in sorted(edges, key=lambda e: (e["part"], e["number"])):
        before = chains[-1][-1] if chains else None
        if before and e["first"] and before["last"] and before["part"] != e["part"] and before["conv"] == e["conv"]:
            chains[-1].append(e)
        else:
            chains.append([e])
    closing = [[(cost, 0) if to == 0 else (_NO, 0) for to in range(4)] for cost in (row[0][1] for row in STEPS[END])]
    out: Fixed = {}
    for chain in chains:
        if len(chain) > 1:
            pairs = [[(v if v >= 0 else _NO, r) for v, r in zip(e["matrix"][::2], e["matrix"][1::2])] for e in chain]
            states = segment_states([*([p[4 * s : 4 * s + 4] for s in range(4)] for p in pairs), closing], 0, 0)
            for i, e in enumerate(chain):
                out[e["part"], e["number"]] = (states[i], states[i + 1] if e is not chain[-1] else None, chain[i - 1]["tail"] if i else None)
    return out


_EDITS = ("conv", "place", "edit", "new_role", "turn", "role", "hash", "cost", "illegal")
_LEGAL = {"su", "ua", "au"}


def _repair(batches: Iterable[pa.RecordBatch], fixed: Fixed, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Per segment one row with all its edits' initials (``new_role`` is null), and one row per row that it leaves or adds."""
    part, out, place = TaskContext.get().partitionId(), [], 0
    for number, conv, rows in _segments(batches):
        start, end, before = fixed.get((part, number), (0, None, None))
        codes = [_codes(r) for r in rows]
        flat = [c for cs in codes for c in cs]
        edits = edits_of(flat if end is not None else [*flat, END], start, end or 0)
        state, cost, illegal, at = start, 0, 0, 0
        first = place = place + 1
        for row, cs in zip(rows, codes):
            initial = _initial(row[2])
            for k, code in enumerate(cs):
                illegal += int((initial if k else before) is not None and (initial if k else before) + initial not in _LEGAL)
                for edit in edits[at]:
                    cost += {"K": 0, "D": DELETE, "R": REROLE, "I": INSERT}[edit] + (edit in "KR" and code % 3 == CUT_OFF) * TRUNCATED
                    if edit == "D":
                        continue
                    state = code // 3 + 1 if edit == "K" else _AFTER_ADDED[state]
                    place += 1
                    role = row[2] if edit == "K" else USER if state == 2 else ASSISTANT
                    out.append((conv, part << 33 | place, edit, role, *((row[1], row[2], row[4]) if edit != "I" else (None,) * 3), None, None))
                at += 1
            before = initial
        for edit in "".join(edits[at:]):
            state, cost, place = _AFTER_ADDED[state], cost + INSERT, place + 1
            out.append((conv, part << 33 | place, edit, USER if state == 2 else ASSISTANT, None, None, None, None, None))
        out.append((conv, part << 33 | first, "".join(edits), None, None, None, None, cost, illegal))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(_EDITS))
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(_EDITS))


class Repaired(NamedTuple):
    #: ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)``, one row per conversation.
    report: DataFrame
    #: ``(conv, place, edit, role, text)``: the repaired conversations, in the order of ``place``.
    rows: DataFrame


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", copies: Column | None = None) -> Repaired:
    """Repairs every conversation.  ``copies`` says how often a row counts (0: not at all, but its
    conversation is reported)."""
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    narrow = cut(_narrow(rows))
    parts = max(shuffle_partitions(rows.sparkSession), -(-narrow.count() // TASK_ROWS))
    ordered = cut(narrow.filter("copies > 0").repartitionByRange(parts, *_PLACE).sortWithinPartitions(*_PLACE)).transform(in_batches)

    kind = rows.schema["conv"].dataType
    conv_type, conv_name = to_arrow_type(kind), kind.simpleString()
    edges = ordered.mapInArrow(lambda it: _edges(it, conv_type), f"part int, number int, first boolean, last boolean, conv {conv_name}, "
                                                                 "matrix array<long>, tail string")
    fixed = _fix_edges(edges.collect())  # at most two rows for each partition
    types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    edits = cut(ordered.mapInArrow(lambda it: _repair(it, fixed, types),
                                   f"conv {conv_name}, place long, edit string, new_role string, turn long, role string, hash string, "
                                   "cost long, illegal long"))

    counted, copies_of = F.col("copies") > 0, F.col("copies")
    turns = F.when(counted, F.col("turn"))
    stats = narrow.groupBy("conv").agg(
        F.coalesce(F.max(turns) - F.min(turns) + 1 - F.count_distinct(turns), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), copies_of).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank") & counted, copies_of - F.col("first").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((~F.col("blank") & counted & F.col("first") & F.col("cut_off")).cast("long")).alias("truncated"))
    solved = edits.filter("new_role IS NULL").groupBy(F.col("conv").alias("c")).agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "edit"))), lambda x: x["edit"]), "").alias("audit"))
    report = stats.join(solved, F.col("conv").eqNullSafe(F.col("c")), "left").select(
        F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"),
        F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))

    texts = rows.filter("copies > 0").select("conv", "turn", "role", "text", F.sha2("text", 256).alias("hash")).dropDuplicates(
        ["conv", "turn", "role", "hash"]).select(*[F.col(c).alias(f"_{c}") for c in ("conv", "turn", "role", "hash")], "text")
    left = edits.filter("new_role IS NOT NULL")
    kept = left.filter("edit != 'I'").join(
        texts, F.col("conv").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
        & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash")))
    out = kept.select("conv", "place", "edit", "new_role", "text").unionByName(
        left.filter("edit = 'I'").select("conv", "place", "edit", "new_role", F.lit("").alias("text")))
    return Repaired(report, out.select(F.col("conv").alias(conv_col), "place", "edit", F.col("new_role").alias("role"), "text"))


def _hash(batches: Iterable[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3))))
    out = []
    for conv, group in groupby(rows, key=lambda r: r[0]):
        h, line = hashlib.sha256(), b""
        for _, role, text in group:
            h.update(line + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            line = b"\n"
        out.append((conv, h.hexdigest()))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (conv_type, pa.string()))], names=["conv", "sha"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (conv_type, pa.string()))], names=["conv", "sha"])


def digests(repaired: Repaired, conv_col: str = "conv_id") -> DataFrame:
    """The report with ``repaired_sha256`` of each conversation's ``role:text`` lines.

    A SHA-256 goes through its text in order, so a conversation's rows stream through one task,
    sorted by Spark (which spills), and are never held there."""
    kind = repaired.rows.schema[conv_col].dataType
    conv_type = to_arrow_type(kind)
    hashed = (repaired.rows.select(F.col(conv_col).alias("c"), "role", "text", "place").repartition("c").sortWithinPartitions("c", "place")
              .drop("place").transform(in_batches).mapInArrow(lambda it: _hash(it, conv_type), f"c {kind.simpleString()}, sha string"))
    return repaired.report.join(hashed, F.col(conv_col).eqNullSafe(F.col("c")), "left").drop("c").withColumn(
        "repaired_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).drop("sha")


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations damaged row by row, by a hash of ``conv_id:turn``, and how often each row counts."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    out = conversations.select(
        "conv_id", "turn", F.when(fault == 4, F.lit(USER)).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
    return out, F.col("copies")
