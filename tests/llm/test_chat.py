import random

from helpers import SF, parity, sha

from panelforge.llm import chat


def fmt(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    return chat.format_conversations(chat.text_parts(df))


def test_control_strings_read_back(spark):
    rng = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "[", "<image:1>", "ok", "\n", "é", "\U0001F600", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "<s>[INST]", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))))
            for c in range(40) for t in range(rng.randint(1, 6))]
    got = {r["conv_id"]: r for r in fmt(spark, rows).collect()}
    for c, r in got.items():
        mine = [(x[2], x[3]) for x in rows if x[0] == c]
        assert chat.parse(r["formatted"]) == mine
        loss = chat.unescape("".join(r["formatted"][s["start"]:s["end"]] for s in r["loss_spans"]))
        assert loss == "".join(t for role, t in mine if role == "assistant")
    back = {r["conv_id"]: r for r in chat.read_back(fmt(spark, rows)).collect()}
    for c, r in back.items():
        mine = [(x[2], x[3]) for x in rows if x[0] == c]
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in mine)) and r["n_turns"] == len(mine)


def test_edge_rows(spark):
    rows = [(1, 2, "assistant", None), (1, 0, None, "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "user", "first"), (None, 0, "user", "x")]
    got = {r["conv_id"]: r["formatted"] for r in fmt(spark, rows).collect()}
    assert chat.parse(got[1]) == [("user", "first"), ("", "a"), ("user", "b"), ("user", "b"), ("assistant", "")]
    assert chat.parse(got[None]) == [("user", "x")]
    assert fmt(spark, []).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see <", "ref": None, "tokens": None}, {"type": "image", "text": None, "ref": "s3://a.png", "tokens": None},
             None, {"type": "image", "text": None, "ref": "b.png", "tokens": 10}, {"type": "audio", "text": None, "ref": "c.wav", "tokens": 5},
             {"type": "document", "text": None, "ref": None, "tokens": None}, {"type": None, "text": "end", "ref": None, "tokens": None}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r["formatted"] == r"<s>user[INST]see \<<image:1><image:2><audio:1><document:1>end</s><s>assistant[INST]</s>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "s3://a.png", 576), ("image", "b.png", 10), ("audio", "c.wav", 5), ("document", None, 1024)]
    assert r["expanded_tokens"] == 1615 and r["loss_spans"] == []
    assert all(r["formatted"][a["position"]:].startswith("<" + a["type"]) for a in r["attachments"])
    assert chat.parse(r["formatted"]) == [("user", "see <end"), ("assistant", "")]


def test_other_part_types(spark):
    part = lambda kind, tokens=None: {"type": kind, "text": "t", "ref": "r", "tokens": tokens}
    df = spark.createDataFrame([(1, 0, "user", [part("video", 9), part("document"), part("turn"), part("")])],
                               f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r["formatted"] == "<s>user[INST]<document:1><document:2><document:3>t</s>"
    assert [(a["type"], a["tokens"]) for a in r["attachments"]] == [("video", 9), ("document", 1024), ("turn", 1024)]
    assert chat.parse(r["formatted"]) == [("user", "t")]


def test_ids_of_any_type(spark):
    rows = [("a", 0, "user", "x"), (None, 0, "user", "y"), ("", 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    back = chat.read_back(chat.format_conversations(chat.text_parts(df))).collect()
    assert sorted((str(r["conv_id"]), r["turns_sha256"]) for r in back) == sorted((str(c), sha(f"{o}\n{t}\n")) for c, _, o, t in rows)
    big = (1 << 60) + 1
    assert {r["conv_id"] for r in fmt(spark, [(big, 0, "user", "x"), (None, 0, "user", "y")]).collect()} == {big, None}


def test_sql(spark):
    parity(spark, "op6_chat_format", SF)
