import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import chat_format as c

PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN:", "[TURN:x]", "]", "[/TURN]", "\\", " ", "\n", "a", "é", "<", "[", "/", "%5D"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "x]y z"]), TEXT), max_size=5))
def test_round_trip(turns):
    rendered = "".join(c.format_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, *_ in c.parse(rendered)] == turns
    for _, t, a, z in c.parse(rendered):
        assert c.unescape(rendered[a:z]) == t


@pytest.mark.parametrize("text", ["x", "[INST] a", "[INST] a </s>\n", "[/INST]\n", "[INST]a [/INST]\n", "[INST] a [/INST]"])
def test_grammar_errors(text):
    with pytest.raises(c.GrammarError):
        c.parse(text)


def test_plain_text_stays_plain():
    assert c.format_turn("user", "a \\ b") == "[INST] a \\ b [/INST]\n"


def brute(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(c.format_turn(r, t)) for r, t in turns)))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s> no"), (1, 1, "assistant", "</s> no"), (2, None, "user", "null turn"), (2, 0, None, None), (3, 5, "tool", "x"), (3, 2, "assistant", None),
    (None, 0, "user", "no id"), (None, 1, "assistant", "né"), (2**60 + 1, 0, "assistant", "big id"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")


@pytest.mark.parametrize("part", [1_000_000, 20])
def test_edges(spark, part, monkeypatch):
    monkeypatch.setattr(c, "PART", part)
    assert sorted(map(tuple, c.conversation_digests(frame(spark, ROWS)).collect()), key=str) == brute(ROWS)


def test_formatted_parts(spark):
    long = [(9, k, "user" if k % 2 else "assistant", f"[INST] {k} " * 4000) for k in range(60)]
    rows = c.format_conversations(frame(spark, ROWS + long)).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.part)):
        whole.setdefault(r.conv_id, ["", []])
        whole[r.conv_id][0] += r.formatted
        whole[r.conv_id][1] += r.loss_spans
    assert sum(r.conv_id == 9 for r in rows) > 1
    for conv, n, turns, _, loss, chars in brute(ROWS + long):
        text, spans = whole[conv]
        assert len(text) == chars and len(c.parse(text)) == n
        assert hashlib.sha256("".join(c.unescape(text[a:z]) for a, z in spans).encode()).hexdigest() == loss


def test_empty(spark):
    assert c.conversation_digests(frame(spark, [])).count() == 0


def test_query_on_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", hard), (-1, 1, "assistant", hard)]
    assert sorted(map(tuple, c.op9_chat_format(spark, small).collect()), key=str) == brute(rows)
