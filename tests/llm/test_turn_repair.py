import hashlib
import random

import pytest
from llm_fixtures import LONG

from tractlens.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies string, place string, conv string"
ADDED = {0: 2, 1: 2, 2: 3, 3: 2}


def best_edits(codes):
    """Brute force: the least (cost, edits) to each state, all strings kept whole."""
    def added(best):
        out = dict(best)
        for _ in range(4):
            for s, (c, e) in list(out.items()):
                out[ADDED[s]] = min(out.get(ADDED[s], (10**9, "")), (c + 2, e + "I"))
        return out

    best = {0: (0, "")}
    for code in codes:
        initial, kind = divmod(code, 3)
        new: dict = {}
        for s, (c, e) in added(best).items():
            reach = [(s, c + 3, "D")]
            if kind != tr.GONE:
                x = int(kind == tr.CUT_OFF)
                if (s, initial) in {(0, 0), (0, 1), (1, 1), (3, 1), (2, 2)}:
                    reach.append((initial + 1, c + x, "K"))
                reach.append((ADDED[s], c + x + 2, "R"))
            for to, cost, edit in reach:
                new[to] = min(new.get(to, (10**9, "")), (cost, e + edit))
        best = new
    best = added(best)
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows):
    """Report and repaired rows of ``(turn, role, text)`` rows, in order."""
    rows = sorted([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows],
                  key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    seen, codes, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        s = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        codes.append(3 * ("sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3) + {"truncated": 1, None: 0}.get(fault, 2))
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = best_edits(codes)
    lines, state, left = [], 0, iter(rows)
    for edit in audit:
        row = next(left) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        state = "sua".index(row[1][0]) + 1 if edit == "K" else ADDED[state]
        lines.append((row[1] if edit == "K" else "user" if state == 2 else "assistant") + ":" + row[2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, "\n".join(lines))


def repaired(df):
    out = tr.digests(tr.repair(df)).collect()
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
            for r in out}, len(out)


def test_divide_and_conquer_equals_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        codes = [rng.randrange(12) for _ in range(rng.randint(0, 9))]
        cost, audit = best_edits(codes)
        assert "".join(tr.hirschberg([*codes, tr.END], 0, 0)) == audit
        if len(codes) > 3:  # the same through segments that are summed up
            a, b = sorted(rng.sample(range(1, len(codes)), 2))
            segments = [codes[:a], codes[a:b], codes[b:]]
            closing = [[(c, 0) if to == 0 else (tr._NO, 0) for to in range(4)] for c in (row[0][1] for row in tr.STEPS[tr.END])]
            states = tr.segment_states([*map(tr.matrix, segments), closing], 0, 0)
            parts = [tr.hirschberg(s, states[i], states[i + 1]) for i, s in enumerate(segments)]
            assert "".join(e for p in parts for e in p) + tr.STEPS[tr.END][states[3]][0][2] == audit


def random_rows(rng, n):
    say = lambda: rng.choice(["Yes.", "No!", "and then", "", " \n", "Why?  ", "same.", f"text {rng.randrange(50)}."])
    return [(rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice([None, *[say() for _ in range(9)]])) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair_equals_brute_force(spark, monkeypatch, partitions):
    monkeypatch.setattr(tr, "shuffle_partitions", lambda spark: partitions)
    rng = random.Random(partitions)
    convs = {c: random_rows(rng, rng.choice([1, 2, 5, 12])) for c in [None, *range(40)]}
    # One conversation with most of the rows: it spans partitions.
    convs[99] = [(t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["x.", "y", f"row {t}."])) for t in range(400)]
    convs[100] = [(3, "user", "copied.")] * 300
    data = [(c, *r, *"zzzz") for c, rows in convs.items() for r in rows]
    rng.shuffle(data)
    got, n = repaired(spark.createDataFrame(data, SCHEMA).repartition(5))
    want = {c: brute(rows) for c, rows in convs.items()}
    assert got == {c: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for c, w in want.items()} and n == len(convs)


def test_odd_conversations(spark):
    rows = [(1, None, None, None, *"zzzz"), (2, 0, "user", LONG + ".", *"zzzz"), (2, 1, "assistant", "ok.", *"zzzz")]
    df = spark.createDataFrame(rows, SCHEMA)
    got, _ = repaired(df)
    assert got[1][:7] == (0, 1, 0, 0, 0, 3, "D") and got[1][7] == hashlib.sha256(b"").hexdigest()
    assert got[2][6] == "KK" and got[2][7] == hashlib.sha256(f"user:{LONG}.\nassistant:ok.".encode()).hexdigest()
    assert repaired(df.limit(0)) == ({}, 0)
    kept = tr.repair(df).rows.orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["edit"], r["role"]) for r in kept] == [(2, "K", "user"), (2, "K", "assistant")]


def test_dropped_rows_leave_their_conversation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7, 0, "user", "a.", *"zzzz")], SCHEMA)
    r = tr.digests(tr.repair(df, copies=F.lit(0))).first()
    assert (r["conv_id"], r["gaps"], r["cost"], r["audit"], r["repaired_sha256"]) == (7, 0, 0, "", hashlib.sha256(b"").hexdigest())
