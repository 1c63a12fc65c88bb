import random
import struct

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import no_docs, odd_docs  # noqa: F401

from conftest import SF001
from tractlens.llm import queries
from tractlens.llm import viterbi_pieces as vp
from tractlens.llm.common import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
PIECES = vp._table(PATH)[1]


def brute(text):
    """Plain Viterbi over the whole marked text, every piece at every place."""
    t = (vp.MARK + text.replace(vp.MARK, vp._LITERAL).replace(" ", vp.MARK)) if text else ""
    best = [(0.0, 0)] + [None] * len(t)
    for end in range(1, len(t) + 1):
        top = (best[end - 1][0] + PIECES.unknown, end - 1)
        for start in range(end - 1, max(-1, end - 17), -1):
            s = PIECES.score.get(t[start:end])
            if s is not None and best[start][0] + s >= top[0]:
                top = (best[start][0] + s, start)
        best[end] = top
    ids, end = [], len(t)
    while end:
        start = best[end][1]
        p = PIECES.id.get(t[start:end])
        ids = ([p] if p is not None else PIECES.bytes_of(t[start:end])) + ids
        end = start
    return ids, best[-1][0]


def score(ids):
    names = {i: p for p, i in PIECES.id.items()}
    return sum(PIECES.score[names[i]] if i in names else 0.0 for i in ids)


def _field(data, at):
    """(field number, wire type, payload start, end) of a protobuf field."""
    def varint(at):
        n = shift = 0
        while True:
            b = data[at]
            n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return n, at
    key, at = varint(at)
    if key & 7 == 2:
        size, at = varint(at)
        return key >> 3, 2, at, at + size
    return key >> 3, key & 7, at, varint(at)[1] if key & 7 == 0 else at + (4 if key & 7 == 5 else 8)


def _message(number, payload):
    size, out = len(payload), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + payload


def unigram_model():
    """The vocabulary file as a unigram model with this operator's scores."""
    data, out, at, i = open(PATH, "rb").read(), b"", 0, 0
    parts = []
    names = {j: p for p, j in PIECES.id.items()}
    while at < len(data):
        number, _, a, b = _field(data, at)
        body = data[a:b]
        if number == 1:
            if i in names:
                k, new = 0, b""
                while k < len(body):
                    f, _, x, y = _field(body, k)
                    new += body[k:y] if f != 2 else body[k:x] + struct.pack("<f", PIECES.score[names[i]])
                    k = y
                body = new
            i += 1
        elif number == 2:
            k, new = 0, b""
            while k < len(body):
                f, _, x, y = _field(body, k)
                new += body[k:y] if f != 3 else body[k:x] + b"\x01"
                k = y
            body = new
        parts.append(_message(number, body))
        at = b
    out = b"".join(parts)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_as_good_as_the_library_on_the_same_scores(spark):
    sp = unigram_model()
    texts = [r["text"] for r in queries.read_table(spark, SF001, "documents").limit(60).collect()]
    flat, n = vp.encode_texts(texts, PATH)
    at = same = total = 0
    for t, k in zip(texts, n.tolist()):
        mine, theirs = flat[at : at + k].tolist(), sp.encode(t)
        at += k
        assert score(mine) >= score(theirs) - 1e-3 * len(mine)
        same += sum(a == b for a, b in zip(mine, theirs)) if len(mine) == len(theirs) else 0
        total += len(mine)
    assert same > 0.9 * total


PARTS = [*"abhe nt. ▁漢😀\n\t\x00é", "the", " the", "   ", "ing", "▁▁"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=20), max_size=4))
def test_equals_plain_viterbi_and_decodes_exactly(texts):
    flat, n = vp.encode_texts(texts, PATH)
    assert flat.tolist() == [i for t in texts for i in brute(t)[0]]
    assert [b.decode("utf-8", "surrogatepass") for b in vp.decode_ids(flat, n, PATH)] == texts


def test_shared_prefixes_change_nothing():
    rng = random.Random(2)
    words = sorted({vp.MARK + "".join(rng.choice("then") for _ in range(rng.randint(0, 12))) for _ in range(500)})
    assert vp.segment_sorted(words, PIECES) == [vp.segment_sorted([w], PIECES)[0] for w in words]


def test_query_round_trips(spark):
    rows = queries.op6_viterbi_pieces(spark, SF001).collect()
    docs = {r["doc_id"]: r["text"] for r in queries.read_table(spark, SF001, "documents").collect()}
    assert len(rows) == len(docs) and all(r["exact"] for r in rows)
    for r in rows[:40]:
        assert r["n_pieces"] == len(brute(docs[r["doc_id"]])[0])


def test_odd_documents(spark, odd_docs, no_docs):
    coded = vp.encode(odd_docs)
    back = sorted((r["doc_id"] or -1, r["text"]) for r in vp.decode(coded).collect())
    assert back == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd_docs.collect())
    assert all(r["exact"] for r in vp.round_trip(odd_docs).collect())
    assert vp.round_trip(no_docs).count() == 0 and vp.decode(vp.encode(no_docs)).count() == 0
