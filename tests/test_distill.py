import hashlib

import pytest
from pyspark.sql import functions as F

from thinkframe.operators import distill as D
from thinkframe.operators.ordering import nth_smallest_hash, seeded_hash

BODY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def traces(spark, rows):
    return spark.createDataFrame(rows, "id string, pos int, task string, question string, gold string, trace string")


def test_filter_keeps_correct_within_limits(spark):
    t = traces(spark, [
        ("a", 0, "gsm8k", "q1", "#### 4", f"<think>{BODY}</think>\nAnswer: 4"),
        ("a", 1, "gsm8k", "q1", "#### 4", f"<think>{BODY}</think>\nAnswer: 5"),
        ("a", 2, "gsm8k", "q1", "#### 4", "<think>short</think>\nAnswer: 4"),
        ("a", 3, "gsm8k", "q1", "#### 4", f"<think>{BODY}{'x' * 6000}</think>\nAnswer: 4"),
        ("b", 0, "arc", "q2", "C", f"  {BODY}\nAnswer: (c)  "),
    ])
    out = D.filter_traces(t, keep_cols=["pos"]).orderBy("id", "pos").collect()
    assert [(r.id, r.pos, r.answer) for r in out] == [("a", 0, "4"), ("b", 0, "(c)")]
    assert out[1].trace == f"{BODY}\nAnswer: (c)"
    assert out[1].meta == {"task": "arc"}
    rate = {r.task: (r.seen, r.kept, r.pct) for r in D.keep_rate(t).collect()}
    assert rate["gsm8k"] == (4, 1, 25.0) and rate["arc"] == (1, 1, 100.0)
    loose = D.filter_traces(t, min_trace_tokens=1, max_trace_chars=10_000)
    assert loose.count() == 4


def test_meta_merge_right_wins(spark):
    df = spark.createDataFrame([({"task": "old", "teacher": "t"},)], "meta map<string,string>")
    assert df.select(D.merge_task("meta", F.lit("arc"))).first()[0] == {"teacher": "t", "task": "arc"}


def test_repair_response(spark):
    df = spark.createDataFrame(
        [("plain reasoning", "7"), ("<think>r</think>\nAnswer: 3", "3"), ("<think>r\nAnswer: 2 inside", "2"),
         ("  x</think> tail ", "9")],
        "t string, a string",
    )
    got = [r[0] for r in df.select(D.repair_response("t", "a")).collect()]
    assert got == [
        "<think>\nplain reasoning\n</think>\nAnswer: 7<|im_end|>",
        "<think>r</think>\nAnswer: 3<|im_end|>",
        "<think>r\nAnswer: 2 inside\n</think><|im_end|>",
        "<think>\nx</think> tail\nAnswer: 9<|im_end|>",
    ]


def test_prompts(spark):
    df = spark.createDataFrame([("2+2?",)], "q string")
    p = df.select(D.chat_prompt("q"), D.teacher_prompt("q")).first()
    assert p[0].startswith("<|im_start|>system\nYou are a careful reasoner.")
    assert p[0].endswith("<|im_start|>user\n2+2?<|im_end|>\n<|im_start|>assistant\n")
    assert p[1].endswith("\n\nProblem:\n2+2?\n\n<think>\n")
    ch = spark.createDataFrame([("Q", (["A", "B", "C"], ["x", "y"]))],
                               "q string, c struct<label:array<string>,text:array<string>>")
    assert ch.select(D.arc_question("q", "c")).first()[0] == (
        "Q\n\nA) x\nB) y\n\nRespond with the letter of the correct choice.")


def _filtered_rows(spark, n_keys=40, copies=3):
    data = []
    for k in range(n_keys):
        for c in range(copies):
            task = ["arc", "gsm8k", "math"][k % 3]
            data.append((str(k), c, f"question {k}", f"trace {k}", "x", {"task": task}))
    return spark.createDataFrame(
        data, "id string, pos int, question string, trace string, answer string, meta map<string,string>"
    ).withColumn("id", F.col("id").cast("int"))


def test_dedupe_cap_split(spark):
    f = _filtered_rows(spark)
    rows = D.sft_rows(f, order_cols=["id", "pos"])
    assert rows.count() == 40 and set(r.pos for r in rows.collect()) == {0}
    again = D.dedupe_first(rows, "key", ["id", "pos"])
    assert again.count() == 40  # idempotent
    capped = D.sft_rows(f, order_cols=["id", "pos"], per_task_cap=5)
    by_task = {r.task: sorted(x.id for x in capped.where(F.col("task") == r.task).collect())
               for r in capped.select("task").distinct().collect()}
    assert by_task["arc"] == [0, 3, 6, 9, 12] and by_task["gsm8k"] == [1, 4, 7, 10, 13]
    assert {r.task: r.rows for r in D.rows_by_task(capped).collect()} == {"arc": 5, "gsm8k": 5, "math": 5}
    split = D.split_train_eval(rows, "key", seed=17, eval_frac=0.1)
    ev = [r.key for r in split.where("split = 'eval'").collect()]
    tr = [r.key for r in split.where("split = 'train'").collect()]
    assert len(ev) == int(40 * 0.1) and not set(ev) & set(tr) and len(tr) == 36
    assert D.split_train_eval(rows, "key", with_eval=False).where("split = 'eval'").count() == 0


def test_nth_smallest_hash_matches_sort(spark):
    df = spark.range(5000).select(seeded_hash(5, F.col("id").cast("string")).alias("m"))
    ms = sorted(r.m for r in df.collect())
    for n in (1, 17, 2500, 5000):
        assert nth_smallest_hash(df, "m", n) == ms[n - 1]
    assert nth_smallest_hash(df, "m", 0) is None


def test_rl_prompts_first_in_order(spark):
    train = spark.createDataFrame(
        [("p1", "x\nAnswer: 4<|im_end|>", "gsm8k", None, "b"),
         ("p1", "y\nAnswer: 5<|im_end|>", "gsm8k", None, "a"),
         ("p2", "Answer: dime<|im_end|>", None, {"gold": "10"}, "c")],
        "prompt string, response string, task string, meta map<string,string>, shuffle_pos string",
    )
    got = sorted(tuple(r) for r in D.rl_prompts(train).select("prompt", "gold", "task").collect())
    assert got == [("p1", "5", "gsm8k"), ("p2", "10", "generic")]


def test_shape_and_explode_records(spark):
    flat = spark.createDataFrame([(1, 1, "q", "g", "t1"), (1, 0, "q", "g", "t0")],
                                 "id int, pos int, question string, gold string, trace string")
    rec = D.shape_records(flat)
    assert rec.first().traces == ["t0", "t1"]
    back = D.explode_records(rec).orderBy("pos").collect()
    assert [(r.pos, r.trace) for r in back] == [(0, "t0"), (1, "t1")]
    many = spark.createDataFrame([(1, p, "q", "g", f"t{p}") for p in range(25)],
                                 "id int, pos int, question string, gold string, trace string")
    parts = D.shape_records(many, max_traces=10)
    assert sorted(len(r.traces) for r in parts.collect()) == [5, 10, 10]
    assert sorted((r.pos, r.trace) for r in D.explode_records(parts).collect()) == sorted((p, f"t{p}") for p in range(25))


def test_union_shards_and_build_dataset(spark):
    a = _filtered_rows(spark, n_keys=6, copies=1)
    b = _filtered_rows(spark, n_keys=6, copies=1)  # same keys again: later shard loses
    u = D.union_shards([a, b])
    assert sorted(set(r.shard_no for r in u.collect())) == [0, 1]
    built = D.build_dataset(u, order_cols=["shard_no", "id", "pos"], eval_frac=0.5, seed=3)
    rows = built.collect()
    assert len(rows) == 6 and {r.shard_no for r in rows} == {0}
    assert sum(r.split == "eval" for r in rows) == 3


def test_nth_smallest_hash_on_edges(spark):
    """Hashes on both sides of a prefix's edge, equal hashes, and too few rows."""
    values = ["0" * 32, "00ff" + "f" * 28, "0100" + "0" * 28, "0100" + "0" * 27 + "1", "ffff" + "f" * 28] + ["00ff" + "0" * 28] * 3
    df = spark.createDataFrame([(v,) for v in values], "m string")
    for n, want in enumerate(sorted(values), 1):
        assert nth_smallest_hash(df, "m", n) == want
    with pytest.raises(ValueError, match="fewer than 9"):
        nth_smallest_hash(df, "m", 9)


def test_split_of_many_rows(spark):
    rows = spark.range(60_001).select(F.md5(F.col("id").cast("string")).alias("key"))
    split = D.split_train_eval(rows, "key", eval_frac=0.1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"eval": 6000, "train": 54001}


def test_join_outputs(spark):
    prompts = spark.createDataFrame([(1, "q1", "g1"), (2, "q2", "g2"), (3, "none", "g3")], "id int, question string, gold string")
    outputs = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c"), (9, 0, "lost")], "id int, pos int, trace string")
    got = sorted((r.id, r.question, r.gold, r.traces) for r in D.join_outputs(prompts, outputs).collect())
    assert got == [("1", "q1", "g1", ["a", "b"]), ("2", "q2", "g2", ["c"])]


def test_records_take_gold_and_meta_of_the_first_sample(spark):
    flat = spark.createDataFrame([(1, 1, "q", "late", "t1"), (1, 0, "q", None, "t0"), (1, 2, "q", "later", "t2")],
                                 "id int, pos int, question string, gold string, trace string")
    assert D.shape_records(flat).first().gold == "late"


def test_missing_id_is_sha2_of_question(spark):
    import hashlib

    flat = spark.createDataFrame([(0, "What is 2+2?", "4", "t0"), (1, "What is 2+2?", "4", "t1")],
                                 "pos int, question string, gold string, trace string")
    rec = D.shape_records(flat, id_col=None).first()
    assert rec.id == hashlib.sha256("What is 2+2?".encode()).hexdigest() and rec.traces == ["t0", "t1"]


@pytest.mark.parametrize("n,frac", [(1, 0.5), (7, 0.02), (333, 0.1), (1000, 0.0), (250, 1.0), (999, 0.37)])
def test_split_sizes_and_membership(spark, n, frac):
    rows = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("key"))
    split = D.split_train_eval(rows, "key", seed=17, eval_frac=frac)
    got = {r.key: r.split for r in split.collect()}
    n_eval = int(n * frac)
    hashes = sorted(hashlib.md5(f"17:{k}".encode()).hexdigest() for k in got)
    expect_eval = set(hashes[:n_eval])
    assert sum(v == "eval" for v in got.values()) == n_eval and len(got) == n
    assert {hashlib.md5(f"17:{k}".encode()).hexdigest() for k, v in got.items() if v == "eval"} == expect_eval
