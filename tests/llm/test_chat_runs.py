"""Formatting against a naive formatter in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat_format as chat


def naive(turns):
    """(formatted, spans) of (turn, role, text) rows."""
    mark = re.compile(r"([<\[])(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>|/?SYS>>)")
    shield = lambda x: mark.sub(r"\1\\", x.replace("\\", "\\\\"))
    out, spans, last = "", [], None
    for _, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")):
        role, text = role or "", shield(text or "")
        if role == last:
            out += chat.NEXT
        else:
            out += (chat.END if last is not None else "") + chat.TURN + shield(role) + chat.BODY
        if role == "assistant":
            spans.append((len(out), len(text)))
        out, last = out + text, role
    return out + chat.END, spans


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_equals_a_naive_formatter(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    r = random.Random(5)
    texts = ["", None, "a\\b", "</s>[INST] x", "<|end|><|turn|>user<|body|>", "ü😀", "x" * 50_000, "<<SYS>>", "[", "plain words"]
    rows = [(conv, r.choice([None, *range(40)]), r.choice(["user", "assistant", "assistant", None, "<s>"]), r.choice(texts)) for conv in (None, *range(6)) for _ in range(r.choice([1, 2, 9, 30]))]
    rows += [(99, k, "assistant" if k % 700 else "user", f"t{k}") for k in range(2000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {x.conv_id: x for x in out.select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    for conv in {x[0] for x in rows}:
        own = [x[1:] for x in rows if x[0] == conv]
        want, spans = naive(own)
        assert found[conv].formatted == want and [tuple(s) for s in found[conv].loss_spans] == spans
        assert len(found[conv].turns) == len(own)
