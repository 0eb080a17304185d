"""Folding, rendering and reading back of conversations against a plain loop over the log."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat

SCHEMA = "conv_id bigint, message_id string, seq bigint, kind string, role string, text string"


def plainly(log):
    """{conv: [(role, text)]} by one pass over the sorted events of each conversation."""
    out = {}
    for conv in {e[0] for e in log}:
        key = lambda e: (e[2] is not None, e[2] or 0, chat.KINDS.index(e[3]), e[5] or "", e[4] or "")
        messages = {}
        for e in sorted((e for e in log if e[0] == conv and e[3] in chat.KINDS), key=key):
            _, name, seq, kind, role, text = e
            own = messages.setdefault((name, None if name else seq), {"at": (seq is not None, seq or 0), "role": None, "text": "", "dead": False, "again": None})
            own["role"] = role if own["role"] is None else own["role"]
            if kind == "delta":
                own["text"] += "" if own["dead"] else text or ""
            else:
                own["text"], own["dead"] = "" if kind == "delete" else text or "", kind == "delete"
            if kind == "regenerate":
                own["again"] = (seq is not None, seq or 0)
        order = sorted(messages.items(), key=lambda m: (m[1]["at"], m[0][0] is not None, m[0][0] or ""))
        left = []
        for i, (_, m) in enumerate(order):
            fallen = any(o["again"] is not None and o["again"] > m["at"] for _, o in order[:i])
            if not m["dead"] and not fallen:
                left.append((m["role"] or "", m["text"]))
        if left:
            out[conv] = left
    return out


def read(spark, log, **more):
    df = spark.createDataFrame(log, SCHEMA).withColumn("stretch", F.lit("clash")).repartition(4)
    made = chat.format_conversations(df, **more)
    turns = {r.conv: [tuple(t) for t in r.turns] for r in made.select("conv", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    loss = {r.conv: list(r.loss) for r in made.select("conv", chat.under_mask(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    return turns, loss


PIECES = ["a", "<turn ", "</turn>", "</turn>\n", "\\", "<", "<\\turn", "<\\\\/turn>\n", ">\n", "\n", "é😀", "﻿", "%3C", "### Assistant:", ""]


@pytest.mark.parametrize("stretch", [3, 256])
def test_random_logs(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    draw = random.Random(stretch)
    log = []
    for conv in range(40):
        for seq in range(draw.randint(1, 60)):
            kind = draw.choices([*chat.KINDS, "unknown"], [4, 1, 1, 1, 8, 1])[0]
            log.append((conv, f"m{draw.randint(0, 9)}", seq, kind, draw.choice(["user", "assistant", None, "r<ole>%3C\n"]), draw.choice(PIECES) + draw.choice(PIECES)))
    turns, loss = read(spark, log)
    assert turns == plainly(log)
    assert loss == {c: [t for r, t in m if r == "assistant"] for c, m in turns.items()}


def test_odd_events(spark):
    log = [(None, "a", 1, "message", "user", "x"), (None, "a", 2, "delta", None, None), (1, None, 5, "message", None, None), (1, None, 6, "message", "assistant", "y"), (1, "b", None, "message", "user", "first"), (2, "a", 1, None, "user", "x"), (2, "a", 2, "typo", "user", "x"), (3, "a", 1, "delete", "user", "x"), (4, "a", 1, "delta", "assistant", "la"), (4, "a", 1, "delta", "assistant", "la")]
    turns, loss = read(spark, log)
    assert turns == plainly(log) == {None: [("user", "x")], 1: [("user", "first"), ("", ""), ("assistant", "y")], 4: [("assistant", "lala")]}
    assert loss == {None: [], 1: ["y"], 4: ["lala"]}
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_regeneration_drops_what_followed(spark):
    log = [(1, "q", 0, "message", "user", "hi"), (1, "r", 1, "message", "assistant", ""), (1, "r", 2, "delta", None, "bad"), (1, "q2", 3, "message", "user", "why"), (1, "r2", 700, "message", "assistant", "so"), (1, "r", 900, "regenerate", None, ""), (1, "r", 901, "delta", None, "go"), (1, "r", 902, "delta", None, "od"), (1, "q3", 903, "message", "user", "ok")]
    assert read(spark, log)[0] == {1: [("user", "hi"), ("assistant", "good"), ("user", "ok")]}


def test_texts_are_left_alone_but_for_control_strings(spark):
    texts = ["plain \\ text", "<turn", "<\\turn", "\\### Assistant: </turn> ok", "if a<b: </p>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [tuple(r) for r in df.select(chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect()]
    assert found == [(e, t) for e, t in zip(["plain \\ text", "<\\turn", "<\\\\turn", "\\### Assistant: <\\/turn> ok", "if a<b: </p>"], texts, strict=True)]


def test_digest_of_a_table_of_turns(spark):
    """The log made of a table folds into its rows, nulls, repeated rows and ties included; long texts whole."""
    long = "".join(random.Random(1).choice("ab <é\n") for _ in range(200_000))
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", long), (2, 0, "assistant", "a1"), (2, 0, "assistant", "a1"), (2, None, "user", "null first"), (3, 5, None, "x" * 100)] + [(9, i, ("user", "assistant")[i % 2], f"{i} text <turn " * (i % 17)) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv: r for r in chat.digest(chat.format_conversations(chat.log_of(df), sequence=("turn", "step"))).collect()}
    for conv in (1, 2, 3, 9):
        own = sorted([(t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or "") for c, t, r, x in rows if c == conv])
        said = "".join(f"{r}\n{x}\n" for _, _, r, _, x in own)
        loss = "".join(x for _, _, r, _, x in own if r == "assistant")
        assert (found[conv].n_turns, found[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    made = chat.digest(chat.format_conversations(chat.log_of(df), sequence=("turn", "step")))
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()
