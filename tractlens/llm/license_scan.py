"""Licence scans: fixed phrases, and template-markup matching by token automata.

Every whole text becomes its word sequence.  A template's automaton runs over a
text that holds the template's longest run of mandatory words; the text is
accepted where all mandatory wording stands word for word, with optional regions
present or absent and replaceable regions of any words.

``score`` is 0 without a finding, 0.5 for a base phrase alone, and for accepted
templates 0.5 + 0.5 * (wording words matched / wording words of the template),
the best of them.

Edge cases: null and empty texts have no words and no findings (empty strings,
null positions, score 0); repeated ids give one row each; texts of any length are
scanned whole, one at a time; an empty table gives an empty table.  Only id and text are read,
so columns with clashing names do no harm.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import ALNUM_LOWER, in_batches, release, raw_bytes
from tractlens.llm.license_templates import TEMPLATES, Automaton, accept, compile_template

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

SCHEMA = ("id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, matches array<struct<label:string,start:long,end:long,wording:long>>")


@functools.lru_cache(maxsize=1)
def automata() -> list[Automaton]:
    return [compile_template(*t) for t in TEMPLATES]


def scan(text: bytes | None, phrases: dict[bytes, str], templates: list[Automaton]) -> tuple:
    words = (text or b"").translate(ALNUM_LOWER).split()
    plain = b" " + b" ".join(words) + b" "
    base, labels, starts = 0, set(), []
    for phrase, label in phrases.items():
        at = plain.find(phrase)
        while at >= 0:
            base += 1
            labels.add(label)
            starts.append(at)
            at = plain.find(phrase, at + 1)
    place = lambda at: plain.count(b" ", 0, at)
    matches, score = [], 0.5 if base else 0.0
    for t in templates:
        if t.anchor in plain:
            for a, b, n in accept(t, words):
                matches.append({"label": t.label, "start": a, "end": b, "wording": n})
                score = max(score, 0.5 + 0.5 * n / t.wording)
    return (len(words), base, place(min(starts)) if starts else None, place(max(starts)) if starts else None,
            ",".join(sorted(labels)), ",".join(sorted(labels | {m["label"] for m in matches})), score, matches)


def _scan(batches: Iterator[pa.RecordBatch], phrases: dict[bytes, str]) -> Iterator[pa.RecordBatch]:
    release()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct(
        [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("wording", pa.int64())]))]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    for batch in batches:
        rows = [scan(t, phrases, automata()) for t in raw_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``; ``phrases`` maps lower-case word sequences to base labels."""
    coded = {f" {p} ".encode(): label for p, label in (phrases or BASE_PHRASES).items()}
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.transform(in_batches).mapInArrow(lambda it: _scan(it, coded), SCHEMA).withColumnRenamed("id", id_col)
