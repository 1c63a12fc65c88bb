import random
import re

import pytest
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from conftest import SF001
from tractlens.llm import license_scan, queries
from tractlens.llm.license_templates import TEMPLATES, accept, compile_template, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {f" {p} ".encode(): label for p, label in license_scan.BASE_PHRASES.items()}


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    found = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words))
             if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def as_regex(markup):
    out, last = "", 0
    for m in re.finditer(r"<<(optional|end|var(?: max=(\d+))?)>>", markup):
        out += "".join(f"{w.decode()} " for w in words_of(markup[last : m.start()]))
        out += "(?:" if m[1] == "optional" else ")?" if m[1] == "end" else rf"(?:\S+ ){{0,{m[2] or ''}}}"
        last = m.end()
    return re.compile(r"(?<!\S)" + out + "".join(f"{w.decode()} " for w in words_of(markup[last:])))


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.read_table(spark, SF001, "documents").collect()}
    got = queries.op7_license_scan(spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(docs[r["doc_id"]])
        plain = " ".join(w.decode() for w in words_of(docs[r["doc_id"]])) + " "
        want = {label for label, markup in TEMPLATES if as_regex(markup).search(plain)}
        assert set(filter(None, r["labels"].split(","))) == want | set(filter(None, r["base_labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_automata_equal_regexes():
    rng = random.Random(7)
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 2)))
            parts.append(rng.choice([w, w, f"<<optional>>{w} <<end>>", f"<<optional>>{w} <<optional>>c <<end>><<end>>",
                                     f"<<var max={rng.randint(1, 3)}>>", "<<var>>"]))
        markup = " ".join(["a", *parts])
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 14))]
        a = compile_template("x", markup)
        plain = " ".join(w.decode() for w in words) + " "
        assert bool(accept(a, words)) == bool(as_regex(markup).search(plain)), (markup, plain)
        for start, end, _ in accept(a, words):
            assert as_regex(markup).fullmatch(" ".join(w.decode() for w in words[start:end]) + " ")


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Released under the MIT License.", "mit"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("licensed under the Apache Licence, Version 2.0", ""),
    ("mit, LICENSE mit license mit license", "mit"),
])
def test_examples(text, labels):
    assert license_scan.scan(text.encode(), PHRASES, license_scan.automata())[5] == labels


FULL = [(label, markup) for label, markup in TEMPLATES if len(words_of(markup)) > 80]


@pytest.mark.parametrize("label, markup", FULL, ids=[label for label, _ in FULL])
def test_whole_wording_with_replaced_regions(label, markup):
    """Every mandatory word counts; replaceable regions take any number of words."""
    full = re.sub(r"<<optional>>|<<end>>", "", markup)
    full = re.sub(r"<<var max=\d+>>", "1", full).replace("<<var>>", "2024 " + "Some One and Others " * 40)
    found = lambda text: license_scan.scan(text.encode(), PHRASES, license_scan.automata())
    row = found("Read this first. " + full + " And go on.")
    assert label in row[5].split(",") and row[6] > 0.95
    words = full.split()
    for k in range(len(words) // 3, len(words), 17):
        if words[k].isalpha() and words[k] not in ("Some", "One", "and", "Others"):
            assert label not in [m["label"] for m in found(" ".join([*words[:k], "otherwise", *words[k + 1 :]]))[7]], words[k]


def test_every_full_licence_is_there():
    assert {label for label, _ in FULL} == {"mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense"}


def test_odd_documents(spark, odd_docs, no_docs):
    rows = license_scan.scan_licenses(odd_docs).collect()
    assert sorted(r["n_words"] for r in rows) == sorted(brute(r["text"])[0] for r in odd_docs.collect())
    none = [r for r in rows if r["doc_id"] == 1][0]
    assert (none["labels"], none["first_word"], none["score"]) == ("", None, 0.0)
    assert license_scan.scan_licenses(no_docs).count() == 0
