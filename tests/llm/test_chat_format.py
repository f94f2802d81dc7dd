import hashlib

import pytest

from scoutline.llm.chat_format import Template, chat_digests, format_chats, read_chats

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> \\ [\\INST]", "<<s>>", "[[INST]]", "a\nb\r\n", "\\", "<", "[", "é😀", "$1 \\1", "</s></s>", "[INST", "INST]", "<s"]


@pytest.mark.parametrize("template", [None, Template(marks={"assistant": ("<a>", "</a>"), "user": ("<u>", "</u>"), "*": ("<x>", "</x>")}, controls=("<a>", "</a>", "<u>", "</u>", "<x>", "</x>"))])
def test_reversible(spark, template):
    rows = [(c, t, ["user", "assistant"][t % 2], text) for c in range(2) for t, text in enumerate(TEXTS[c:] + TEXTS[:c])]
    rows += [(9, 0, "a\\b\nc\\n", "</a>"), (9, 1, "</s>", "<s>")]
    chats = format_chats(frame(spark, rows), template)
    back = {r.conv_id: r for r in read_chats(chats, template).collect()}
    for c in (0, 1, 9):
        own = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == [(r[2], r[3]) for r in own]
        assert back[c].loss_text == "".join(r[3] for r in own if r[2] == "assistant")


def test_loss_flags_and_order_of_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "u"), (3, 0, "user", "u"), (4, 0, "assistant", "a"), (5, 0, "tool", "t")]
    got = {r.conv_id: r for r in format_chats(frame(spark, rows)).collect()}
    assert {k: (r.valid, r.final_state) for k, r in got.items()} == {1: (True, "answered"), 2: (False, "invalid"), 3: (False, "asked"), 4: (False, "invalid"), 5: (False, "invalid")}
    assert [(s.text, s.loss) for s in got[1].segments if s.loss] == [("a", True)]
    assert "".join(s.text for s in got[1].segments) == got[1].formatted


def test_edges(spark):
    rows = [(1, 1, None, None), (1, None, "assistant", "é"), (1, 1, None, None), (None, 0, "user", "x"), (2, 0, "assistant", "y" * 300_000)]
    got = {r.conv_id: r for r in chat_digests(frame(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("assistant\né\n\n\n\n\n"), 1, sha("é"))
    assert (got[None].n_turns, got[None].loss_chars, got[None].loss_sha256) == (1, 0, sha(""))
    assert got[2].formatted_chars == 300_000 + len("<s>assistant\n</s>")
    assert chat_digests(frame(spark, []).limit(0)).collect() == []


def test_order_of_turns_reaches_the_digests(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (None, 0, "user", "p"), (None, 1, "assistant", "q")]
    got = sorted((r.conv_id or 99, r.n_turns, r.valid, r.final_state) for r in chat_digests(frame(spark, rows)).collect())
    assert got == [(1, 2, True, "answered"), (2, 1, False, "invalid"), (3, 1, False, "ready"), (99, 1, False, "asked"), (99, 1, False, "invalid")]
