"""The query renders whole prefixes: a template that looks back is formatted as it would write all turns at once."""

import functools
import os
import random

import pytest

from evalspark.llm import chat, queries


def numbered(turns):
    """``chatml`` with the number of each turn in its role."""
    return chat.chatml([(f"{k} {role}", text) for k, (role, text) in enumerate(turns)])


def by_last_speaker(turns):
    """``chatml`` with the role of the turn before in each role."""
    return chat.chatml([(f"{before} {role}", text) for before, (role, text) in zip(["", *(r for r, _ in turns)], turns)])


@pytest.mark.parametrize("render", [numbered, by_last_speaker])
def test_query_renders_whole_prefixes(spark, tmp_path, monkeypatch, render):
    turns = [(("user", "assistant")[k % 2], f"said {k} <|im_end|>") for k in range(40)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(queries, "format_conversations", functools.partial(chat.format_conversations, render=render))
    got = {r.conv_id: r for r in queries.op11_incremental_rendering(spark, str(tmp_path)).collect()}
    assert got[1].formatted_chars == len(render(turns))
    assert got[1].loss_chars == sum(len(t) for r, t in turns if r == "assistant")


def test_common_start():
    draw = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(draw.choices("ab\U0001f600", [9, 1, 1], k=draw.randrange(40))) for _ in range(2))
        b = a[: draw.randrange(len(a) + 1)] + b
        assert chat.common_start(a, b) == len(os.path.commonprefix([a, b])) == chat.common_start(b, a)
