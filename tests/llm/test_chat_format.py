import hashlib
import random

from tractlens.llm import chat_format

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def fold(events):
    """Brute force: one event after the other."""
    messages = {}
    order = sorted(events, key=lambda e: (e[1], e[3] or "delta", (e[4] is not None, e[4] or ""), e[5] or ""))
    for conv, _, message, kind, role, text in order:
        if kind == "regenerate":
            for m in [m for c, m in messages if c == conv and m > message]:
                del messages[conv, m]
        old_role, old_text = messages.get((conv, message), ("", ""))
        if kind in ("edit", "regenerate"):
            old_role, old_text = "", ""
        messages[conv, message] = (role if role is not None else old_role, old_text + (text or ""))
    return messages


def test_fold_equals_brute_force(spark):
    rng = random.Random(5)
    events = []
    for conv in range(40):
        for seq in range(rng.randint(1, 25)):
            events.append((conv, seq, rng.randint(0, 3), rng.choice(["delta", "delta", "edit", "regenerate", None]),
                           rng.choice(["user", "assistant"]), rng.choice(["a", "b ", None, ""])))
    rng.shuffle(events)
    got = chat_format.fold_events(spark.createDataFrame(events, EVENTS)).collect()
    assert {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in got} == fold(events)


def test_escaped_texts_read_back(spark):
    texts = ["", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nhi", "<\\|x", "<\\\\|", "<", "|<|", "a\n\nb", "漢<|é", "\\", "<|nl|>"]
    rows = [(1, i, i, "delta", role, t) for i, (role, t) in enumerate(
        (r, t) for t in texts for r in ("user", "assistant", "a\nb", "<|nl|>"))]
    out = chat_format.format_chats(spark.createDataFrame(rows, EVENTS))
    parsed = chat_format.parse(out).first()
    assert [(t["role"], t["text"]) for t in parsed["turns"]] == [(r[4], r[5]) for r in rows]
    said = [r[5] for r in rows if r[4] == "assistant"]
    assert parsed["loss_text"] == said
    d = chat_format.digests(out).first()
    assert d["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
    assert d["n_turns"] == len(rows) and d["formatted_chars"] == len(parsed["formatted"])


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (None, 0, None, "hi", "x"), (2, None, "assistant", "t" * 300_000, "x")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digests(
        chat_format.format_chats(chat_format.conversation_events(c))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nhi\n").hexdigest()
    assert got[2]["loss_chars"] == 300_000
    empty = chat_format.format_chats(chat_format.conversation_events(c.limit(0)))
    assert chat_format.digests(empty).count() == 0


def test_only_native_operators(spark):
    c = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.digests(chat_format.format_chats(chat_format.conversation_events(c)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas"))
