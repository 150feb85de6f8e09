"""Chat formatting: exact round trips, and the digests against plain ones."""

from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import chat

PIECES = st.lists(st.one_of(st.sampled_from([*chat.MARKS, chat.ESCAPE, "<", "[", "/", "<<", "</", "]", ">", "S", "\n", "é漢🙂", ""]), st.text(max_size=4)), max_size=12).map("".join)
ROLES = st.one_of(st.sampled_from([*chat.TEMPLATE, "tool", ""]), PIECES)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, PIECES), max_size=5))
def test_turns_come_back_from_the_whole_text(turns):
    """Turns are rendered one by one; the parser reads their concatenation."""
    rendered = [chat.render_turn(*t) for t in turns]
    whole = "".join(r[0] for r in rendered)
    assert [t[:2] for t in chat.parse(whole)] == turns
    at = 0
    for (out, begins, ends), (_, text, b, e) in zip(rendered, chat.parse(whole), strict=True):
        assert (b, e) == (at + begins, at + ends)
        at += len(out)


def test_only_conflicts_are_escaped():
    assert chat.render_turn("user", "plain [x] </p>") == ("[INST]plain [x] </p>[/INST]", 6, 20)
    assert chat.render_turn("user", chat.PLANTED)[0] == "[INST]\\</s>\\[INST] ok \\[/INST][/INST]"
    assert chat.render_turn("assistant", "a\\b")[0] == "<s>a\\\\b</s>"
    assert chat.render_turn("tool", "x")[0] == "<<ROLE>>tool<</ROLE>>x<<END>>"


@pytest.mark.parametrize("text", ["[INST]a", "<s>a", "a", "<s>a</s>b", "<s>[INST]</s>", "<<ROLE>>tool<<END>>", "<s>a\\"])
def test_broken_texts_are_refused(text):
    with pytest.raises(chat.BrokenText):
        list(chat.parse(text))


ROWS = [
    (1, 2, "assistant", "second</s>"), (1, 1, "user", "first [INST]"), (1, 0, "system", "be kind"), (1, 3, "user", None), (1, 4, "assistant", None),
    (2, 0, "assistant", "only \\ this"), (2, 0, "assistant", "only \\ this"), (2, None, "tool", "</s>"), (2, 0, None, "no role"),
    (3, 0, "user", ""), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (4, 0, "assistant", "<s>" * 20_000 + "\\" * 20_000 + "é漢🙂" * 20_000),
]


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        length = sum(len(chat.render_turn(r[2] or "", r[3] or "")[0]) for r in mine)
        out[conv] = (len(mine), sha256(turns.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), length)
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_start string")


def test_digests_read_back(spark):
    got = chat.read_back(chat.format_turns(conversations(spark, ROWS))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain(ROWS) and len(got) == 5


def test_mask_covers_the_assistant_alone(spark):
    for r in chat.format_turns(conversations(spark, ROWS)).collect():
        if r["role"] == "assistant":
            back = list(chat.parse("<s>" + r["formatted"][r["loss_start"] : r["loss_end"]] + "</s>"))
            assert len(back) == 1 and r["formatted"][: r["loss_start"]] == "<s>"
        else:
            assert r["loss_start"] is None and r["loss_end"] is None


def test_a_long_conversation_is_streamed(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"turn {i} \\ [INST]") for i in range(5_000)]
    got = chat.read_back(chat.format_turns(conversations(spark, rows))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain(rows)


def test_empty_table(spark):
    assert chat.read_back(chat.format_turns(conversations(spark, ROWS).limit(0))).count() == 0
