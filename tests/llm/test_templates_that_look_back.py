"""Templates that look at turns long past: a conversation's length changes nothing of how it is formatted."""

import pytest

from evalspark.llm import chat


def counting(turns):
    """Turns with their number."""
    return "".join(f"{k} {role}: {text}\n" for k, (role, text) in enumerate(turns))


def by_first(turns):
    """Every turn begins with the first turn's text."""
    return "".join(f"[{turns[0][1]}] {role}: {text}\n" for role, text in turns)


@pytest.mark.parametrize("render", [counting, by_first])
@pytest.mark.parametrize("n", [1, 63, 64, 65, 150])
def test_long_conversations(spark, render, n):
    turns = [(("user", "assistant")[k % 2], f"said {k}") for k in range(n)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), render)
    whole = chat.whole_texts(formatted).collect()[0]
    assert whole.text == render(turns)
    assert [whole.text[s.start : s.end] for s in whole.loss_spans] == [t for r, t in turns if r == "assistant"]


def test_no_context_is_enough_for_chatml():
    turns = [("user", "<|im_end|>"), ("assistant", ""), ("user", "é"), ("assistant", "b")] * 40
    own = list(chat.turn_pieces(iter(turns), chat.chatml, frozenset({"assistant"}), chat.CHATML_CONTEXT))
    assert own == list(chat.turn_pieces(iter(turns), chat.chatml, frozenset({"assistant"}), None))
