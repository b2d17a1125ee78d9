"""Wide rows move once: findings of round 3 on disk, memory and time."""

import pytest
from pyspark.sql import functions as F

from thinkframe.functions import text as T
from thinkframe.operators import distill as D
from thinkframe.operators import encode as E
from thinkframe.plans import catalog as C
from thinkframe.sources import fixture as X
from thinkframe.sources import io


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(i if i % 7 else None, f"Question {i % 50} of {'many words ' * 12}", "en", f"src{i % 3}", 9) for i in range(90)]
    rows += rows[:3]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def all_of(df):
    return sorted(map(str, df.collect()))


def test_f1_f2_f11_f14_survivors_meet_their_rows_where_these_lie(no_broadcast, folder):
    spark = no_broadcast
    dealt = C._sft(spark, folder)
    plain = D.sft_rows(C._filtered(spark, folder), ["id", "pos"])
    assert "SortMergeJoin" not in plan(spark, dealt)
    assert dealt.count() > 50 and all_of(dealt.drop("home")) == all_of(plain)
    batches = [E.assign_batches(r, "key", E.encoded_length(), seed=3, **at) for r, at in ((plain, {}), (dealt, {"home": "home", "parts": X.dealt_parts(spark, folder)}))]
    assert "SortMergeJoin" not in plan(spark, batches[1])
    assert all_of(batches[0]) == all_of(batches[1].drop("home"))


def test_f3_f5_f12_f13_records_are_grouped_and_sorted_where_they_lie(no_broadcast, folder):
    rec = C._records(no_broadcast, folder)
    assert plan(no_broadcast, rec.orderBy("id")).count("Exchange") == 1  # the documents, once
    flat = D.shape_records(X.with_meta(X.traces(no_broadcast, folder)), meta=F.col("meta"))
    assert all_of(C._record_digest(rec)) == all_of(C._record_digest(flat))


def test_f3_f4_f10_files_may_be_compressed_and_lines_stay(no_broadcast, tmp_path):
    df = no_broadcast.range(300).select(F.format_string("%04d", "id").alias("id"), F.repeat(F.lit("wide "), 99).alias("question"))
    sizes = []
    for kind in (None, "gzip"):
        io.write_jsonl(df, str(tmp_path / f"{kind}"), order_by=["id"], compression=kind)
        back = io.read_numbered_jsonl(no_broadcast, str(tmp_path / f"{kind}"), "id string, question string")
        assert "BroadcastHashJoin" in plan(no_broadcast, back)  # the lines stay where they are read
        assert [(r.id, r.src_ordinal) for r in back.orderBy("src_ordinal").collect()] == [(f"{i:04d}", i) for i in range(300)]
        sizes.append(sum(f.stat().st_size for f in (tmp_path / f"{kind}").glob("part-*")))
    assert sizes[1] * 5 < sizes[0]


def test_f6_f8_buckets_follow_the_table(spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    few = X.dealt_parts(spark, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        assert X.dealt_parts(spark, folder) > few
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_f9_rl_prompts_are_told_apart_without_a_sort(no_broadcast):
    rows = [("p", "b", "m", "Answer: 2"), ("p", "a", "m", "Answer: 1"), ("q", "c", None, "Answer: 3"), (None, "d", "m", "Answer: 4")]
    out = D.rl_prompts(no_broadcast.createDataFrame(rows, "prompt string, shuffle_pos string, task string, response string"))
    assert "SortMergeJoin" not in plan(no_broadcast, out)
    assert sorted((str(r.prompt), r.gold, r.task) for r in out.collect()) == [("None", "4", "m"), ("p", "1", "m"), ("q", "3", "generic")]


def test_f16_outputs_meet_prompts_without_a_sort(no_broadcast):
    prompts = no_broadcast.createDataFrame([(1, "q", "g"), (2, "r", "h")], "id long, question string, gold string")
    out = D.join_outputs(prompts, no_broadcast.createDataFrame([(1, 1, "b"), (1, 0, "a"), (3, 0, "c")], "id long, pos int, trace string"))
    assert "SortMergeJoin" not in plan(no_broadcast, out)
    assert [(r.id, r.question, r.gold, r.traces) for r in out.collect()] == [("1", "q", "g", ["a", "b"])]


def test_f17_samples_of_the_vote_are_read_once(no_broadcast, folder):
    assert plan(no_broadcast, C.q_leader_changes(no_broadcast, folder)).count("FileScan") == 1


def test_f7_f15_f18_each_answer_is_worked_out_once(spark):
    rows = [("a", "1"), ("a", "1"), ("a", None), ("b", "1"), ("a", None)]
    out = C._counted(spark.createDataFrame(rows, "form string, answer string"), "form", "answer")
    assert sorted((r.form, str(r.answer), r.n) for r in out.collect()) == [("a", "1", 2), ("a", "None", 2), ("b", "1", 1)]
    assert T.evaluate_once(out, m=F.col("n")).where("m = 1").count() == 1
