import json
import tempfile

import pytest

from thinkframe.plans.pipelines import report
from thinkframe.sources import first_per_key, hot_keys, io, read_numbered_jsonl, write_bucketed


def test_jsonl_round_trip_keeps_order_and_unicode(spark):
    d = tempfile.mkdtemp(prefix="tf-io-")
    path = f"{d}/a.jsonl"
    with open(path, "w", encoding="utf-8") as f:
        for i in range(5):
            f.write(json.dumps({"id": str(i), "question": f"q{i} é", "gold": "1", "traces": ["Answer: 1"]}, ensure_ascii=False) + "\n")
        f.write("\n")
    df = io.read_jsonl(spark, path, io.TEACHER_RECORD)
    got = [(r.id, r.question) for r in df.orderBy(*io.SOURCE_ORDER).collect()]
    assert got == [(str(i), f"q{i} é") for i in range(5)]
    io.write_jsonl(df.select("id", "question", "meta"), f"{d}/out", order_by=["id"])
    back = spark.read.json(f"{d}/out")
    assert back.count() == 5 and "meta" in back.columns


def test_optional_eval_and_missing_results(spark):
    d = tempfile.mkdtemp(prefix="tf-io-")
    with open(f"{d}/train.jsonl", "w") as f:
        f.write(json.dumps({"prompt": "p", "response": "r", "task": "arc"}) + "\n")
    train, ev = io.read_train_eval(spark, f"{d}/train.jsonl", f"{d}/missing.jsonl")
    assert train.count() == 1 and ev is None
    rows = spark.createDataFrame([(1, True), (2, False)], "id int, correct boolean")
    io.write_eval(rows, f"{d}/res/arc_c.m1")
    lines = [r.line for r in report(spark, f"{d}/res", ["m1", "m2"]).orderBy("line_no").collect()]
    assert lines[3] == "| ARC-Challenge | 0.500 | n/a |"


def test_broken_lines_stop_the_read(spark):
    import pytest

    d = tempfile.mkdtemp(prefix="tf-io-")
    with open(f"{d}/a.jsonl", "w") as f:
        f.write('{"id": "1", "question": "q", "gold": "1", "traces": ["a"]}\n{"id": "2", broken\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        io.read_jsonl(spark, f"{d}/a.jsonl", io.TEACHER_RECORD).collect()


def test_files_are_read_in_the_given_order_whatever_their_sizes(spark):
    d = tempfile.mkdtemp(prefix="tf-io-")
    want = []
    for name, n in (("a", 2), ("b", 400), ("c", 30)):
        with open(f"{d}/{name}.jsonl", "w") as f:
            for i in range(n):
                want.append(f"{name}{i}")
                f.write(json.dumps({"id": want[-1], "question": "q" * 50, "gold": "1", "traces": ["x"]}) + "\n")
    paths = [f"{d}/{x}.jsonl" for x in "abc"]
    df = io.read_jsonl(spark, paths, io.TEACHER_RECORD)
    assert [r.id for r in df.orderBy(*io.SOURCE_ORDER).collect()] == want
    assert [r.id for r in io.read_jsonl(spark, d, io.TEACHER_RECORD).orderBy(*io.SOURCE_ORDER).collect()] == want


def test_unreadable_eval_file_is_none(spark):
    d = tempfile.mkdtemp(prefix="tf-io-")
    for name, text in (("train", '{"prompt": "p"}\n'), ("bad", '{"prompt": "p"}\nnot json\n'), ("good", '{"prompt": "e"}\n')):
        with open(f"{d}/{name}.jsonl", "w") as f:
            f.write(text)
    assert io.read_train_eval(spark, f"{d}/train.jsonl", f"{d}/bad.jsonl")[1] is None
    assert io.read_train_eval(spark, f"{d}/train.jsonl", f"{d}/good.jsonl")[1].first().prompt == "e"


def test_model_tags_may_hold_dots(spark):
    d = tempfile.mkdtemp(prefix="tf-io-")
    rows = spark.createDataFrame([(1, True)], "id int, correct boolean")
    io.write_eval(rows, f"{d}/arc_c.qwen2.5-1.5b")
    assert [(r.bench, r.model) for r in io.read_eval_results(spark, d).collect()] == [("arc_c", "qwen2.5-1.5b")]


def test_written_fields_are_the_given_ones(spark):
    d = tempfile.mkdtemp(prefix="tf-io-")
    df = spark.createDataFrame([("b", 2), ("a", 1)], "x string, place int")
    io.write_jsonl(df, f"{d}/out", order_by=["place"], columns=["x"])
    back = spark.read.json(f"{d}/out")
    assert back.columns == ["x"] and [r.x for r in back.collect()] == ["a", "b"]


@pytest.mark.parametrize("size", ["64b", "1000b", "128m"])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, size):
    """Blank lines count, files follow each other by name, paths as given."""
    want, rows = [], 0
    for path, name, n in (("b", "part-1", 40), ("b", "part-0", 7), ("b", "part-2", 0), ("a", "only", 25)):
        (tmp_path / path).mkdir(exist_ok=True)
        lines = ["" if i % 5 == 3 else "  " if i % 11 == 10 else json.dumps({"id": f"{path}{name}{i}", "question": "é" * (i * 7 % 50)}, ensure_ascii=False) for i in range(n)]
        (tmp_path / path / name).write_text("\n".join(lines) + ("\n" if n % 2 else ""), encoding="utf-8")
    for no, path in enumerate(("b", "a")):
        for file in sorted((tmp_path / path).iterdir()):
            text = file.read_text(encoding="utf-8")
            for i, line in enumerate(text.split("\n")[: -1 if text.endswith("\n") else None] if text else []):
                if line.strip():
                    want.append((json.loads(line)["id"], no, i, rows))
                rows += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        out = read_numbered_jsonl(spark, [str(tmp_path / "b"), str(tmp_path / "a")], "id string, question string")
        got = [(r["id"], r["src_file_no"], r["src_line"], r["src_ordinal"]) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got, key=lambda r: r[3]) == want


def test_numbered_lines_stop_at_a_broken_record(spark, tmp_path):
    (tmp_path / "x").write_text('{"id": "1"}\n{"id": \n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_numbered_jsonl(spark, str(tmp_path / "x"), "id string").collect()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_tables_join_and_dedupe_without_an_exchange(spark, tmp_path, no_broadcast):
    from thinkframe.operators.distill import dedupe_first
    from thinkframe.operators.rewards import attach_prompts

    c = spark.range(400).selectExpr("cast(id % 37 as string) prompt_id", "id pos", "concat('Answer: ', id) text")
    p = spark.range(40).selectExpr("cast(id as string) prompt_id", "cast(id as string) gold", "'gsm8k' task")
    own = write_bucketed(c, "t_completions", ["prompt_id"], ["pos"], buckets=4, path=str(tmp_path / "c"))
    prompts = write_bucketed(p, "t_prompts", ["prompt_id"], buckets=4, path=str(tmp_path / "p"))
    joined = attach_prompts(own, prompts)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, attach_prompts(c, p).collect()))
    firsts = first_per_key(own, ["prompt_id"], ["pos"])
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert sorted(map(tuple, firsts.collect())) == sorted(map(tuple, dedupe_first(c, "prompt_id", ["pos"]).collect()))
    assert len([f for f in (tmp_path / "c").iterdir() if f.name.startswith("part")]) <= 4  # a file per bucket
    spark.sql("DROP TABLE t_completions")
    spark.sql("DROP TABLE t_prompts")


def test_hot_keys_are_told_before_a_table_is_bucketed(spark):
    df = spark.range(1000).selectExpr("if(id < 340, 'hot', cast(id as string)) k")
    assert [tuple(r) for r in hot_keys(df, ["k"]).collect()] == [("hot", 340)]
