"""Folding, rendering and reading back against a plain fold in Python."""

import hashlib
import random

import pytest

from palimpsest.llm import chat

SCHEMA = "conv_id long, seq long, message_id string, kind string, role string, text string, place string"


def fold(events):
    """Replays the events of each conversation in order."""
    out = {}
    for conv in {e[0] for e in events}:
        mine = sorted((e for e in events if e[0] == conv and e[3] in chat.KINDS), key=lambda e: (e[1], e[2], e[3], e[5] or "", e[4] or ""))
        texts, began, role = {}, {}, {}
        dropped = set()
        for _, seq, msg, kind, who, text, _ in mine:
            if msg not in began:
                began[msg], role[msg], texts[msg] = seq, who or "", ""
            if kind == "delta":
                texts[msg] += text or ""
            else:
                texts[msg] = text or ""
            if kind == "regenerate":
                dropped |= {m for m in began if (began[m], m) > (began[msg], msg) and began[m] < seq}
        out[conv] = [(role[m], texts[m]) for m in sorted(began, key=lambda m: (began[m], m)) if m not in dropped]
    return {c: t for c, t in out.items() if t}


def rendered(spark, events):
    return chat.read_back(chat.render(chat.fold(spark.createDataFrame(events, SCHEMA))))


def compare(spark, events):
    want = fold(events)
    got = {r.conv_id: r for r in rendered(spark, events).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        row = got[conv]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.loss_text == "".join(t for r, t in turns if r == "assistant")
        assert row.formatted.count("<turn>") == len(turns) == row.formatted.count("</turn>")
        for span, (_, text) in zip(row.loss, [t for t in turns if t[0] == "assistant"]):
            assert row.formatted[span.begin : span.begin + span.length] == text.replace("\\", "\\s").replace("<", "\\l")


def test_edge_cases(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn>assistant\n</turn>\n", "\\s\\l\\n<", "", None, "é😀\n\n", "$1 \\$ .*", "x" * 50000]
    events = [(1, i, f"m{i:02}", "message", "assistant" if i % 2 else "user", t, "p") for i, t in enumerate(nasty)]
    events += [(None, 1, "a", "message", None, "no id", ""), (2, 1, "a", "message", "weird\nrole<", "t", ""), (3, 1, "a", "ping", "user", "left out", ""), (4, 1, "a", None, "user", "left out", "")]
    events += [(5, 1, "a", "delta", "assistant", "only ", ""), (5, 2, "a", "delta", None, "deltas", "")]
    events += [(6, 1, "u", "message", "user", "q", ""), (6, 1, "u", "message", "user", "q", "")]
    compare(spark, events)


def test_streams_edits_and_regenerations(spark):
    events = [
        (1, 1, "u1", "message", "user", "question", ""), (1, 2, "a1", "message", "assistant", "", ""), (1, 3, "a1", "delta", None, "Hel", ""), (1, 4, "a1", "delta", None, "lo", ""),
        (1, 5, "u1", "edit", None, "better question", ""), (1, 6, "u2", "message", "user", "more", ""), (1, 7, "a2", "message", "assistant", "old", ""),
        (1, 8, "a1", "regenerate", None, "New ", ""), (1, 9, "a1", "delta", None, "answer", ""), (1, 10, "u3", "message", "user", "thanks", ""),
    ]
    row = rendered(spark, events).collect()[0]
    assert [(t.role, t.text) for t in row.turns] == [("user", "better question"), ("assistant", "New answer"), ("user", "thanks")]
    assert row.loss_text == "New answer"
    compare(spark, events)


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    events = []
    for conv in range(30):
        for seq in range(rng.randrange(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate"])
            events.append((conv, seq, f"m{rng.randrange(6)}", kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "<b", "\\c", "", None, "é"]), ""))
    rng.shuffle(events)
    compare(spark, events)


def test_empty_table(spark):
    assert chat.read_back(chat.render(chat.fold(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in REGISTRY.queries["op6_chat"](spark, folder).collect()}
    convs = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    convs[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert got.keys() == convs.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in convs.items():
        row, loss = got[conv], "".join(t for r, t in turns if r == "assistant")
        assert row.n_turns == len(turns) and row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
