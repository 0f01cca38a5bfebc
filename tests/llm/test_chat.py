"""Chat formatting: exact round trips, merged turns, spans, and conversations of many chunks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from railframe.llm import chat
from railframe.llm.common import saved
from railframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def in_order(rows):
    """conv -> its (role, text), nulls empty, in the order of turn (null first), role and text."""
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def by_hand(rows):
    def esc(s):
        s = s.replace("\\", "\\\\")
        for x in chat.CONTROL:
            s = s.replace(x, x[0] + "\\" + x[1:])
        return s

    for conv, turns in in_order(rows).items():
        out, last = chat.BEGIN, None
        for role, text in turns:
            out += chat.NEXT if role == last else (chat.END if last is not None else "") + chat.TURN + esc(role) + chat.TEXT
            out += esc(text)
            last = role
        yield conv, turns, out + chat.END + chat.FINISH


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def checked(spark, rows, columns="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, columns)
    chats = saved(chat.formatted(df), "chats")
    texts, spans, chunks = {}, {}, {}
    for r in sorted(chats.collect(), key=lambda r: r["chunk"]):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["formatted"]
        spans.setdefault(r["conv_id"], []).extend(r["formatted"][s["start"] : s["end"]] for s in r["loss"])
        chunks.setdefault(r["conv_id"], []).append((r["chunk"], r["chunks"]))
    want = list(by_hand([r[:4] for r in rows]))
    assert texts == {conv: text for conv, _, text in want}
    assert all(own == [(i, len(own)) for i in range(len(own))] for own in chunks.values())
    turns = {}
    for r in sorted(chat.read_back(chats).collect(), key=lambda r: r["chunk"]):
        turns.setdefault(r["conv_id"], []).extend(map(tuple, r["turns"]))
    assert turns == {conv: own for conv, own, _ in want}
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digest(chat.read_back(chats)).collect()}
    learned = {conv: "".join(t for role, t in own if role == "assistant") for conv, own, _ in want}
    assert got == {conv: (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(learned[conv]), sha(learned[conv]), len(text)) for conv, own, text in want}
    assert sorted(len(s) for s in spans.values()) == sorted(sum(role == "assistant" for role, _ in own) for _, own, _ in want)
    return chunks, texts


HARD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<|next|><|end|>", "a\nb\n", "<<s>>", "<<SYS>>x<</SYS>>", "[[INST]]", "é😀<|turn|>user<|text|>", "ends with \\", "\n", "<|im_start|>$1\\1", None]


def test_hard_texts_come_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "<|end|>", "", None]), "".join((rng.choice(HARD) or "") for _ in range(rng.randrange(4)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (100, None, None, None), (101, 0, "assistant", None), (101, 0, "assistant", None), (102, 5, "user", "b"), (102, 5, "assistant", "a"), (102, -3, "user", "c")]
    rows += [(200 + i, 0, "assistant", t) for i, t in enumerate(HARD)]
    checked(spark, [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, turns int")


@pytest.mark.parametrize("limit", [10, 100_000])
def test_conversations_of_many_chunks(spark, monkeypatch, limit):
    monkeypatch.setattr(chat, "CHUNK_CHARS", 2000)
    monkeypatch.setattr(chat, "RANGE_ROWS", 40)
    monkeypatch.setattr(chat, "BROADCAST_LONG", limit)
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(HARD)) for t in range(300)]
    rows += [(8, 0, "assistant", "same")] * 120 + [(None, t, "assistant", "ü" * t) for t in range(90)]  # ties, one role throughout, no id
    rows += [(9, 0, "user", "long " * 3000), (9, 1, "assistant", "long\\" * 3000)]
    rows += [(20 + i, 0, "user", "short") for i in range(30)] + [(60 + i, t, "assistant", "x" * 300) for i in range(12) for t in range(6)]
    rng.shuffle(rows)
    chunks, texts = checked(spark, rows)
    assert len(chunks[7]) > 10 and len(chunks[8]) > 5 and len(chunks[None]) > 5 and len(chunks[20]) == 1
    assert texts[8].count(chat.TURN) == 1 and texts[8].count(chat.NEXT) == 119


def test_loss_of_another_role_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r")], "conv_id long, turn long, role string, text string")
    assert [r["learned"] for r in chat.read_back(chat.formatted(df, learned="user")).collect()] == [["q", "r"]]
    assert chat.digest(chat.read_back(chat.formatted(df.limit(0)))).count() == 0


def test_query_holds_the_table_and_the_added_conversation(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["formatted_chars"]) for r in QUERIES["op11_chat_formatting"](spark, SF).collect()}
    assert got == {c: (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(text)) for c, own, text in by_hand(rows)}


def test_formatting_runs_no_python(spark, capsys):
    df = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string").where(F.col("turn") == 0)
    chat.formatted(df).explain()
    assert "Python" not in capsys.readouterr().out.replace("Scan ExistingRDD", "")
