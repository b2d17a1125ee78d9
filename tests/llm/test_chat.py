"""Chat formatting: fingerprints, layouts and exact round trips."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thinkframe.llm import chat
from thinkframe.llm.queries import QUERIES

HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\<|", "<\\|im_end|>", "<<SYS>>x<</SYS>>", "", "a\nb", "<s>", "[INST]\\", "é\U0001f600"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read_back(spark, rows):
    return chat.parsed(chat.formatted(chat.canonical_turns(turns(spark, rows)))).collect()


def test_hard_texts_come_back_and_hide_no_control_string(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in HARD for r in ("user", "assistant", "odd\nrole <|"))]
    for segment in chat.formatted(turns(spark, rows)).collect():
        inside = segment["segment"][len(chat.OPEN) : -len(chat.CLOSE)]
        assert not any(x in inside for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
    got = {r["turn"]: (r["role"], r["text"], r["loss_text"]) for r in read_back(spark, rows)}
    assert got == {i: (r, t, t if r == "assistant" else "") for _, i, r, t in rows}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("\\<|>[]/sINTim_end \n\ts"), max_size=25), min_size=1, max_size=60))
def test_random_texts_come_back(spark, texts):
    got = {r["turn"]: r["text"] for r in read_back(spark, [(1, i, "user", t) for i, t in enumerate(texts)])}
    assert got == dict(enumerate(texts))


def test_digests(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (2, None, "assistant", "null turn first"), (None, 0, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    segments = chat.formatted(chat.canonical_turns(turns(spark, rows)))
    sizes = {r["conv_id"]: r["n"] for r in segments.groupBy("conv_id").agg(F.sum(F.length("segment")).alias("n")).collect()}
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(chat.parsed(segments)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {
        1: (2, sha("user\none\nassistant\ntwo\n"), 3, sha("two"), sizes[1]),
        2: (2, sha("assistant\nnull turn first\n\n\n"), 15, sha("null turn first"), sizes[2]),
        3: (2, sha("user\nsame\n" * 2), 0, sha(""), sizes[3]),
        None: (1, sha("user\nx\n"), 0, sha(""), sizes[None]),
    }


def test_no_conversations(spark):
    assert chat.digests(chat.parsed(chat.formatted(chat.canonical_turns(turns(spark, []))))).count() == 0


def test_typed_layouts(spark):
    listed = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")]), (2, None), (3, [])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in chat.canonical_turns(listed).orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    fixed = spark.createDataFrame([(1, "do", "", "done"), (2, "do", "this", None)], "conv_id long, instruction string, input string, output string")
    assert sorted(map(tuple, chat.canonical_turns(fixed).collect())) == [(1, 0, "user", "do"), (1, 1, "assistant", "done"), (2, 0, "user", "do\nthis")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, strange string"))
    extra = turns(spark, [(1, 0, "user", "x")]).withColumn("tag", F.lit(1))
    assert chat.canonical_turns(extra, ignore=("tag",)).count() == 1
    both = spark.createDataFrame([(1, "p", "r", "c")], "conv_id long, prompt string, response string, completion string")
    with pytest.raises(ValueError, match="several mappings"):
        chat.canonical_turns(both)
    more = both.withColumn("system", F.lit("s"))  # system, prompt and response are the largest layout it holds
    assert [r["text"] for r in chat.canonical_turns(more).orderBy("turn").collect()] == ["s", "p", "r"]


def test_query_with_further_columns(spark, tmp_path):
    """Columns whose names the operator or its output use change nothing."""
    rows = [(1, 0, "user", "one"), (1, 1, "assistant", "two"), (2, 0, "user", "three"), (None, None, None, None)]
    plain = turns(spark, rows)
    plain.write.parquet(str(tmp_path / "a" / "conversations.parquet"))
    wide = plain
    for name in ("n_turns", "text2", "segment", "chars", "loss_text", "fingerprint", "k", "t", "prompt"):
        wide = wide.withColumn(name, F.lit("clash"))
    wide.withColumn("nested", F.struct(F.lit(1).alias("a"))).write.parquet(str(tmp_path / "b" / "conversations.parquet"))
    query = QUERIES["op7_chat_formatting"]
    assert sorted(map(str, query(spark, str(tmp_path / "a")).collect())) == sorted(map(str, query(spark, str(tmp_path / "b")).collect()))


def test_json_records_without_turns_are_not_lost(spark):
    records = [
        (1, '{"prompt":"","response":""}'), (2, '{"messages":[]}'), (3, '{"messages":null}'), (4, '{"prompt":"p","response":""}'),
        (5, '{"conversations":[{"from":"human","value":"q"}]}'), (6, ""), (7, "{}"), (None, '{"prompt":null,"response":null}'),
    ]
    found, left = chat.canonical_turns_of_json(spark.createDataFrame(records, "id long, raw string"), "id", "raw")
    assert sorted(map(tuple, found.collect())) == [(4, 0, "user", "p"), (5, 0, "user", "q")]
    assert {(r["id"], r["raw"]) for r in left.collect()} == {r for r in records if r[0] not in (4, 5)}


def test_json_records_of_mixed_layouts(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})),
        (2, json.dumps({"output": "done", "instruction": "do", "input": ""})),
        (3, json.dumps({"prompt": "p", "response": "r"})),
        (4, json.dumps({"question": "7?", "answer": 7})),
        (5, json.dumps({"unknown": [1, 2]})), (6, "broken {"), (7, None),
    ]
    found, left = chat.canonical_turns_of_json(spark.createDataFrame(records, "id long, raw string"), "id", "raw")
    assert sorted(map(tuple, found.collect())) == [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "do"), (2, 1, "assistant", "done"),
        (3, 0, "user", "p"), (3, 1, "assistant", "r"), (4, 0, "user", "7?"), (4, 1, "assistant", "7"),
    ]
    rest = {r["id"]: r["fingerprint"] for r in left.collect()}
    assert set(rest) == {5, 6, 7} and rest[5] and rest[6] is None and rest[7] is None


def test_fingerprints_depend_on_nested_paths_only():
    a = chat.fingerprint(["b[].y", "b[].x", "a"])
    assert a == chat.fingerprint(["a", "b[].x", "b[].y"])
    assert len({a, chat.fingerprint(["a", "b.x", "b.y"]), chat.fingerprint(["a", "b[].x"])}) == 3
