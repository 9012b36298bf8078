"""Chat formatting: against its SQL, exact ways back, and layouts told apart."""

from __future__ import annotations

import hashlib
import json

import duckdb
from pyspark.sql import functions as F

from quillon.llm import chat


def write(spark, path, rows):
    spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "conv_id long, turn long, role string, text string, mapping int, turns int, loss int").write.parquet(f"{path}/conversations.parquet")
    return str(path)


HARD = ["<turn user>", "</turn>", "\\", "\\l", "\\e\\g<>", "a\\", "<", ">", "", "\n", "\U0001f600<", "\\\\e", "x" * 70_000 + "<" * 20_000]


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    relation = con.sql(chat.SQL)
    theirs = {r[relation.columns.index("conv_id")]: dict(zip(relation.columns, r)) for r in relation.fetchall()}
    mine = {r.conv_id: r.asDict() for r in chat.op4_schema_fingerprints(spark, sf).collect()}
    assert mine == theirs and -7 in mine


def test_hard_texts_come_back(spark, tmp_path):
    rows = [(i, k, role, text) for i, text in enumerate(HARD) for k, role in enumerate(("user", "assistant", "we<i>rd\n"))]
    rows += [(100, 0, None, None), (100, None, "assistant", "first"), (101, 0, "user", "tie"), (101, 0, "user", "tie"), (101, 0, "assistant", "z"), (None, 1, "user", "no id")]
    found = {r.conv_id: r for r in chat.op4_schema_fingerprints(spark, write(spark, tmp_path, rows)).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    for i, text in enumerate(HARD):
        assert found[i].n_turns == 3 and found[i].turns_sha256 == sha([("user", text), ("assistant", text), ("we<i>rd\n", text)])
        assert found[i].loss_chars == len(text) and found[i].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert found[100].turns_sha256 == sha([("assistant", "first"), ("", "")])
    assert found[101].turns_sha256 == sha([("assistant", "z"), ("user", "tie"), ("user", "tie")])
    assert None in found and found[-7].loss_chars == len("\\### Assistant: </turn> ok")


def test_empty_table_gives_the_planted_conversation(spark, tmp_path):
    assert [r.conv_id for r in chat.op4_schema_fingerprints(spark, write(spark, tmp_path, [])).collect()] == [-7]


def test_control_strings_occur_as_marks_only(spark):
    df = spark.createDataFrame([([("user", t), ("assistant", t)],) for t in HARD], "turns array<struct<role: string, text: string>>")
    for r in df.select(chat.render(F.col("turns")).alias("f")).collect():
        assert r.f.count("<") == 4 and r.f.count("</turn>") == 2


def test_layouts_become_the_same_turns(spark):
    pair = [("user", "why?"), ("assistant", "because <b>")]
    layouts = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in pair]},
        "conversations": {"conversations": [{"from": "human", "value": "why?"}, {"from": "gpt", "value": "because <b>"}]},
        "instruction": {"instruction": "why?", "input": "", "output": "because <b>"},
        "prompt": {"completion": "because <b>", "prompt": "why?"},
        "response": {"prompt": "why?", "response": "because <b>"},
        "question": {"question": "why?", "answer": "because <b>"},
        "system prompt": {"system_prompt": "", "question": "why?", "response": "because <b>"},
        "message parts": {"messages": [{"role": r, "content": [{"type": "text", "text": t}]} for r, t in pair]},
        "mixed messages": {"messages": [{"role": "user", "content": [{"type": "image", "url": "u"}, {"type": "text", "text": "why?"}]}, {"role": "assistant", "content": "because <b>"}]},
        "message texts": {"messages": [{"role": r, "text": t} for r, t in pair]},
        "instruction only": {"instruction": "why?", "output": "because <b>"},
        "unknown": {"foo": [1, 2], "bar": {"x": 1}},
    }
    more = {n: {**v, "id": 7, "source": {"name": "s", "tags": ["a"]}} for n, v in layouts.items()}
    more["messages"] = {"messages": [{"role": r, "content": t, "name": None, "score": [1]} for r, t in pair], "id": "x"}
    rows = [(n, json.dumps(v), 1, 2) for each in (layouts, more) for n, v in each.items()] + [("unknown", None, 1, 2), ("unknown", "not json", 1, 2), ("unknown", "", 1, 2), ("unknown", "[1]", 1, 2), ("unknown", '{"messages": "text"}', 1, 2)]
    out = chat.canonical_json(spark.createDataFrame(rows, "name string, raw string, key int, value int")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.mapping == r.name and r.key == 1
        assert [(t.role, t.text) for t in r.turns] == ([] if r.name == "unknown" else pair)
    joined = chat.canonical_json(spark.createDataFrame([(json.dumps({"instruction": "a", "input": "b", "output": "c"}),)], "raw string")).first()
    assert joined.turns[0].text == "a\n\nb"


def test_texts_that_look_like_json_stay_texts(spark):
    raw = json.dumps({"prompt": '[{"text": "x"}]', "response": '{"a": 1}'})
    row = chat.canonical_json(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row.mapping == "response" and [t.text for t in row.turns] == ['[{"text": "x"}]', '{"a": 1}']


def test_layouts_are_told_to_full_depth(spark):
    rows = [('{"b": {"y": 1, "x": 2}, "a": [{"q": {"r": [{"s": 1}]}}]}',), ('{"a": [{"q": {"r": [{"s": "t"}]}}], "b": {"x": "z", "y": true}}',), ('{"a": [{"q": {"r": [{"u": 5}]}}], "b": {"x": "z", "y": 2.5}}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw string").select(chat.layout(F.col("raw"))).collect()]
    assert got[0] == got[1] != got[2]
    prints = [r[0] for r in spark.createDataFrame([(["b", "a", "b"],), (["a", "b"],), (["a"],)], "p array<string>").select(chat.fingerprint(F.col("p"))).collect()]
    assert prints[0] == prints[1] != prints[2]


def test_each_conversation_goes_by_its_own_layout(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "system", ""), (3, 1, "user", ""), (3, 2, "assistant", ""), (4, 0, "user", "only"), (5, 0, "user", ""), (5, 1, "assistant", "")]
    rows += [(None, 0, "user", "first"), (None, 1, "assistant", "second")]
    folder = write(spark, tmp_path, rows)
    out = chat.format_conversations(spark.read.parquet(f"{folder}/conversations.parquet")).select("conv_id", "mapping", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: r.mapping for r in out if r.conv_id} == {1: "response", 2: "system prompt", 3: "messages", 4: "messages", 5: "response"}
    for r in out:
        if r.conv_id:
            assert [(t.role, t.text) for t in r.turns] == [(role, text) for i, _, role, text in rows if i == r.conv_id]
    assert sorted(r.turns[0].text for r in out if r.conv_id is None) == ["first", "second"] and len(out) == 7


def test_main_path_is_native(spark, sf):
    plan = chat.op4_schema_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_typed_layout_without_mapping(spark):
    df = spark.createDataFrame([(1, "x")], "id int, foo string")
    assert chat.canonical_typed(df, ["foo"]).first().mapping == "unknown"
    qa = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert [t.role for t in chat.canonical_typed(qa, ["question", "answer"]).first().turns] == ["user", "assistant"]
