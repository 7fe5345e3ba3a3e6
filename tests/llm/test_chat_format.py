"""Chat formatting against a plain computation, with odd rows and typed parts."""

import collections
import hashlib
import random

from fieldloom.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string, parts string, content int, block long"
SIGNS = ("\\", "\\b", "\\l", "\\n", "<", "#", "\n", "<turn>", "</turn>", "\\### Assistant: </turn> ok", "<image 0>", "é", "😀", "a", " ")


def escape(t):
    return t.replace("\\", "\\b").replace("<", "\\l").replace("#", "\\h")


def expected(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in [*rows, (-7, 0, "user", queries.TRICKY), (-7, 1, "assistant", queries.TRICKY)]:
        by[c].append((turn is not None, turn or 0, (role or "").encode(), escape(text or "").encode(), role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for c, turns in by.items():
        told = [(x[4], x[5]) for x in sorted(turns)]
        loss = "".join(t for r, t in told if r == "assistant")
        whole = "".join(f"<turn>#{escape(r)}\n{escape(t)}</turn>\n" if "\n" not in r else f"<turn>#{escape(r)}{'x' * r.count(chr(10))}\n{escape(t)}</turn>\n" for r, t in told)
        out.append((c, len(told), sha("".join(f"{r}\n{t}\n" for r, t in told)), len(loss), sha(loss), len(whole)))
    return out


def test_what_is_read_back_equals_what_went_in(spark, tmp_path):
    r = random.Random(5)
    rows = [(k % 40, r.choice((0, 1, 2, 3, 300, 700, -5)), r.choice(("user", "assistant", "system", "a\\n\nb#<", "")), "".join(r.choice(SIGNS) for _ in range(r.randint(0, 9)))) for k in range(400)]
    rows += [(None, 1, "user", "x"), (50, None, None, None), (50, 0, "assistant", None), (50, 0, "assistant", None), (51, 1, "user", ""), (52, 0, "assistant", "long # " * 50_000)]
    rows += [(60, k, ("user", "assistant")[k % 2], f"turn {k} <") for k in range(3000)]
    spark.createDataFrame([(*x, "p", 1, 2) for x in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(x) for x in queries.op13_chat_format(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [x["conv_id"] for x in queries.op13_chat_format(spark, str(tmp_path)).collect()] == [-7]


def test_typed_parts(spark):
    first = '[{"type":"text","text":"see <image 0> "},{"type":"image","ref":"a.png","width":57,"height":28},{"type":"text","text":" and "},{"type":"audio","ref":"b.wav","seconds":1.5},{"type":"image","ref":"a.png"}]'
    second = '[{"type":"document","ref":"c.pdf","pages":3},{"type":"video","ref":"d"},{"text":"no type"},{"type":"text"}]'
    df = spark.createDataFrame([(1, 1, "assistant", second), (1, 0, "user", first), (2, 0, "user", None), (2, 1, "user", "[]"), (2, 2, "user", "no json")], "conv_id long, turn long, role string, json string")
    out = {x["conv_id"]: x for x in chat_format.read_back(chat_format.formatted(df.withColumn("parts", chat_format.parts_of_json(df["json"])))).collect()}
    a = out[1]
    assert a["text"] == "<turn>#user\nsee \\limage 0> <image 0> and <audio 1><image 2></turn>\n<turn>#assistant\n<document 0><part 1><part 2></turn>\n"
    assert [tuple(x) for x in a["attachments"]] == [(0, "image", "a.png", 0, 3), (0, "audio", "b.wav", 1, 38), (0, "image", "a.png", 2, 0), (1, "document", "c.pdf", 0, 1536), (1, "part", "d", 1, 0), (1, "part", None, 2, 0)]
    assert a["n_tokens_attached"] == 3 + 38 + 1536
    assert [tuple(t) for t in a["turns"]] == [("user", "see <image 0> <image 0> and <audio 1><image 2>", False), ("assistant", "<document 0><part 1><part 2>", True)]
    assert [t["text"] for t in out[2]["turns"]] == ["", "", ""] and out[2]["attachments"] == []


def test_a_text_that_does_not_fit_its_spans_is_not_read(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn long, role string, t string")
    made = chat_format.formatted(df.withColumn("parts", chat_format.text_part(df["t"])))
    assert chat_format.read_back(made.withColumn("text", made["text"].substr(1, 12))).first()["turns"] is None


def test_no_python_and_one_row_a_turn_moves(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x", "", 1, 1)], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.op13_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 2
