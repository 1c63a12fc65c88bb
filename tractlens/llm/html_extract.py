"""HTML extraction by nearest-URL page differencing.

Pages are sorted by (host, path, id, url).  Each page is paired with the neighbour in
that order, on its host, whose path shares the longer prefix with its own (the earlier
page on a tie).  Copies (neighbours with the same lines) and pages without lines are
skipped: they would delete all of a page, or nothing.  A page of the same path with other
lines is a neighbour, since one path may serve many pages by its query.  The two pages'
lines (text blocks of the parsed markup) are aligned by longest common subsequence, and
shared lines are deleted, unless the markup proves them to be the article's own
(<article> or <main>): repeated passages of articles stay.  Lines that the markup
proves to be menus, headers, footers, sidebars, notices, adverts, forms or reader
comments go even where they differ.  If a page marks an article, its text is the
article's lines; else all remaining lines.

*Parts.*  The order is cut into parts at keys drawn from a sample (which only balances the
work), so that a hot host is in many tasks.  A first pass sums up each part's ends: its first
and last page, and the first and last that differ from these, with their lines as hashes.  A
scan over these few facts of each part finds the page before and after every part, through
any number of parts that hold copies of one page, and those pages' hashes join the part they
are needed in, in the same shuffle.  So a page's text depends on neither the number of parts
nor any setting.

Edge cases: null and empty pages have an empty text; a host's only page is parsed
without a pair; pages without a host pair among themselves; equal urls and repeated
rows are ordered by id and then by content, and one row each remains; texts of any
length are parsed whole; an empty table gives an empty table.  Only the three named columns
are read, so columns with clashing names do no harm.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import BATCH_ROWS, cut, in_batches, release, shuffle_partitions
from tractlens.llm.html_parse import parse
from tractlens.llm.url_filter import host_and_path

#: Sampled pages for each part.
SAMPLED = 20
_ZONE = {"a": "article", "c": "chrome", "p": "plain"}


class Page:
    """A page's place and lines; a neighbour from another part has its lines' hashes only."""

    def __init__(self, row: tuple, host: str, path: str, lines: list[tuple[str, str]] | None, hashes: bytes | None = None):
        self.row, self.host, self.path, self.lines, self._hashes = row, host, path, lines, hashes

    @property
    def hashes(self) -> bytes:
        if self._hashes is None:
            self._hashes = hash_lines(t for t, _ in self.lines)
        return self._hashes

    def same(self, other: "Page") -> bool:
        return self.host == other.host and self.hashes == other.hashes


def hash_lines(lines: Iterable[str]) -> bytes:
    return b"".join(xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for t in lines)


def _numbers(page: Page) -> list[bytes]:
    return [page.hashes[i : i + 8] for i in range(0, len(page.hashes), 8)]


def common_lines(a: list, b: list) -> set[int]:
    """Indices in ``a`` of a longest common subsequence with ``b`` (bit-parallel; len(a) * len(b) bits)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for y in b:
        v = rows[-1]
        u = v & places.get(y, 0)
        rows.append(((v + u) | (v - u)) & full)
    i, j = len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(head + i)
    return out


def main_text(lines: list[tuple[str, str]], shared: set[int]) -> tuple[str, int]:
    """(text, lines deleted because they are shared)."""
    left = [(t, z) for i, (t, z) in enumerate(lines) if z == "article" or i not in shared]
    own = [t for t, z in left if z == "article"] or [t for t, z in left if z == "plain"]
    return "\n\n".join(own), len(lines) - len(left)


def _nearest(before: Page | None, page: Page, after: Page | None) -> Page | None:
    near = [p for p in (before, after) if p is not None and p.host == page.host]
    return max(near, key=lambda p: len(commonprefix((p.path, page.path))), default=None)


def _run(before: Page | None, run: list[Page], after: Page | None) -> Iterator[tuple]:
    """Finished rows of consecutive copies, which share their neighbours."""
    texts: dict[tuple, tuple[str, int]] = {}
    for page in run:
        near = _nearest(before, page, after)
        key = id(near), tuple(z for _, z in page.lines)  # zones may differ though the lines don't
        if key not in texts:
            texts[key] = main_text(page.lines, common_lines(_numbers(page), _numbers(near)) if near else set())
        yield (*page.row, *texts[key])


def _finished(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of a part, in order, between the pages before and after it (places 0 and 2).  A run of
    copies is finished when the next page that is none is known."""
    before: Page | None = None
    run: list[Page] = []
    for _, place, i, url, host, path, _, lines in rows:
        if place != 1:
            page = Page((i, url), host, path, None, lines)
        else:
            told = [(x[1:], _ZONE[x[0]]) for x in lines.decode("utf-8", "surrogatepass").split("\n")] if lines else []
            if not told:
                yield i, url, "", 0
                continue
            page = Page((i, url), host, path, told)
        if place == 0:
            before = page
        elif place == 2:
            yield from _run(before, run, page)
            return
        elif run and page.same(run[0]):
            run.append(page)
        else:
            yield from _run(before, run, page)
            before, run = run[-1] if run else before, [page]
    yield from _run(before, run, None)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.string(), pa.int64()))],
            names=["id", "url", "text", "n_shared"])
        done.clear()
        return out

    for _, part in groupby(_rows(batches), key=lambda r: r[0]):
        for row in _finished(part):
            done.append(row)
            if len(done) >= BATCH_ROWS:
                yield flush()
    if done:
        yield flush()


# Parts and their ends ---------------------------------------------------------------
_PARSED = "part int, place int, id long, url string, host string, path string, content long, lines binary"
_ORDER = ("part", "place", "host", "path", "id", "url", "content")
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _key(host: str, path: str, page_id: int | None, url: str | None) -> tuple:
    """Compares as Spark sorts: nulls first."""
    return host, path, page_id is not None, page_id or 0, url is not None, url or ""


def _parse(batches: Iterable[pa.RecordBatch], starts: list[tuple], hashed: bool) -> Iterator[pa.RecordBatch]:
    """Pages with their part and lines (zone letter and text each), or their lines' hashes."""
    for batch in batches:
        out = []
        for i, url, host, path, content, markup in _rows([batch]):
            lines = parse(markup)
            told = (hash_lines(t for t, _ in lines) if hashed
                    else "\n".join(z[0] + t for t, z in lines).encode("utf-8", "surrogatepass"))
            out.append((bisect_right(starts, _key(host, path, i, url)), 1, i, url, host, path, content, told))
        cols = zip(*out) if out else [()] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=list(_ORDER[:2]) + ["id", "url", "host", "path", "content", "lines"])


def _part_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: its first page, the first that differs from it, the last page before the last
    run of copies, and the last page (named 0 to 3; 1 and 2 are missing where all are copies)."""
    for part, rows in groupby(_rows(batches), key=lambda r: r[0]):
        ends: dict[int, Page] = {}
        for _, _, i, url, host, path, _, hashes in rows:
            if not hashes:
                continue
            page = Page((i, url), host, path, None, hashes)
            if 0 not in ends:
                ends[0] = page
            elif not page.same(ends[3]):
                ends.setdefault(1, page)
                ends[2] = ends[3]
            ends[3] = page
        if ends:
            cols = zip(*[(part, k, *p.row, p.host, p.path, xxhash.xxh3_128_hexdigest(p.hashes), p.hashes) for k, p in sorted(ends.items())])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["source", "end", "id", "url", "host", "path", "digest", "lines"])


def _beside(ends: dict[int, dict[int, tuple[str, str]]], towards: int) -> list[tuple[int, int, int]]:
    """(part, part and end of the page beside it): the last page before each part (``towards`` 0) or the
    first after it (2) that is no copy of the part's own edge page.  ``ends`` holds hosts and digests."""
    own, other, near, far = (0, 2, 3, 3) if towards == 0 else (3, 1, 0, 0)
    out: list[tuple[int, int, int]] = []
    run: tuple[int, int] | None = None  # the page passed last
    past: tuple[int, int] | None = None  # the page before the run of copies that it belongs to
    for part in sorted(ends, reverse=towards == 2):
        mine = ends[part]
        goes_on = run is not None and ends[run[0]][run[1]] == mine[own]
        beside = past if goes_on else run
        if beside and ends[beside[0]][beside[1]][0] == mine[own][0]:
            out.append((part, *beside))
        past = (part, other) if other in mine else beside
        run = (part, near)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            partitions: int | None = None) -> DataFrame:
    """``(id, url, text, n_shared)``, one row per row of ``pages``."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host.alias("host"),
                     path.alias("path"), F.xxhash64(html_col).alias("content"), F.col(html_col).alias("html"))
    parts = partitions or shuffle_partitions(spark)
    starts = _starts(d.select("host", "path", "id", "url"), parts)

    def parsed(hashed: bool) -> DataFrame:
        return d.transform(in_batches).mapInArrow(lambda it: _parse(it, starts, hashed), _PARSED)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(parts, "part").sortWithinPartitions(*_ORDER).transform(in_batches)

    out = parsed(False)
    if starts:
        ends = cut(in_order(parsed(True)).mapInArrow(_part_ends, "source int, end int, id long, url string, host string, path string, "
                                                                 "digest string, lines binary"))
        facts: dict[int, dict[int, tuple[str, str]]] = {}
        for r in ends.select("source", "end", "host", "digest").collect():  # at most four for each part
            facts.setdefault(r["source"], {})[r["end"]] = (r["host"], r["digest"])
        needed = [(part, place, *at) for place in (0, 2) for part, *at in _beside(facts, place)]
        if needed:
            wanted = F.broadcast(spark.createDataFrame(needed, "part int, place int, source int, end int"))  # two for each part
            out = out.unionByName(ends.join(wanted, ["source", "end"]).withColumn("content", F.lit(0).cast("long")).select(*out.columns))
    got = in_order(out).mapInArrow(_extract, "id long, url string, text string, n_shared long")
    return got.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_shared")


def _starts(keys: DataFrame, parts: int) -> list[tuple]:
    """Where parts begin but for the first, evenly spaced over a sample by hash."""
    every = max(1, keys.count() // (parts * SAMPLED)) if parts > 1 else 0
    if not every:
        return []
    sample = sorted(_key(*r) for r in keys.filter(F.pmod(F.xxhash64(*keys.columns), F.lit(every)) == 0).collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
