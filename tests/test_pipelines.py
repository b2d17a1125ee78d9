import json
import os
import tempfile

from thinkframe.plans import pipelines as PL
from thinkframe.sources import io

BODY = " ".join(f"w{i}" for i in range(20))


def _write_records(path, task, golds, answers):
    with open(path, "w", encoding="utf-8") as f:
        for i, (g, ans) in enumerate(zip(golds, answers)):
            traces = [f"<think>{BODY} {i} {j}</think>\nAnswer: {a}" for j, a in enumerate(ans)]
            rec = {"id": f"{task}{i}", "question": f"{task} question {i}", "gold": g, "traces": traces,
                   "meta": {"dataset": "d", "split": "train", "teacher": "t", "k": len(ans), "temperature": 0.7}}
            f.write(json.dumps(rec, ensure_ascii=False) + "\n")


def test_distill_and_build_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="tf-e1-")
    _write_records(f"{d}/gsm8k.jsonl", "gsm8k", ["#### 4"] * 30, [["4", "5", "4.0"]] * 30)
    _write_records(f"{d}/arc.jsonl", "arc", ["C"] * 30, [["C", "(c)", "A"]] * 30)
    shards = []
    for task in ("gsm8k", "arc"):
        shards.append((task, io.read_jsonl(spark, f"{d}/{task}.jsonl", io.TEACHER_RECORD)))
    out = PL.distill_and_build(spark, shards, f"{d}/out", per_task_cap=25, eval_frac=0.1)
    rates = {r.task: (r.seen, r.kept) for r in out["keep_rate"].collect()}
    assert rates == {"gsm8k": (90, 60), "arc": (90, 60)}
    split = out["split"]
    assert split.count() == 50                      # 60 distinct per task, capped at 25
    assert split.where("split = 'eval'").count() == 5
    train = spark.read.json(f"{d}/out/train")
    assert train.count() == 45 and set(train.columns) == {"prompt", "response", "task", "meta"}
    assert train.first().meta.temperature == "0.7" and train.first().meta.k == "3"
    assert os.path.isdir(f"{d}/out/filtered/task=arc")
    assert set(spark.read.json(f"{d}/out/rl_prompts").columns) == {"prompt", "gold", "task"}
    rl = spark.read.json(f"{d}/out/rl_prompts").collect()
    assert len(rl) == len({r.prompt for r in rl}) and all(r.gold in ("4", "4.0", "C", "(c)") for r in rl)


def test_evaluate_and_rewards_jobs(spark):
    comp = spark.createDataFrame(
        [(1, p, "gsm8k", f"Answer: {a}") for p, a in enumerate(["4", "4", "5"])]
        + [(2, p, "arc", f"Answer: {a}") for p, a in enumerate(["B", "A", "A"])],
        "id int, pos int, task string, trace string",
    )
    items = {"gsm8k": spark.createDataFrame([(1, "x #### 4")], "id int, answer string"),
             "arc_c": spark.createDataFrame([(2, "b")], "id int, answerKey string")}
    d = tempfile.mkdtemp(prefix="tf-e2-")
    res = PL.evaluate_benches(comp, items, out_dir=f"{d}/runs", model="m1")
    acc = {r.bench: r.acc for r in res["accuracy"].collect()}
    assert acc == {"gsm8k": 1.0, "arc_c": 0.0}
    lines = [r.line for r in PL.report(spark, f"{d}/runs", ["m1"]).orderBy("line_no").collect()]
    assert lines[3:] == ["| ARC-Challenge | 0.000 |", "| GSM8K | 1.000 |", "| MATH-500 | n/a |"]
    prompts = spark.createDataFrame([(1, "4", "gsm8k"), (2, "B", "arc")], "prompt_id int, gold string, task string")
    scored = PL.score_rewards(comp.withColumnRenamed("id", "prompt_id").withColumnRenamed("trace", "text"), prompts)
    assert scored.count() == 6 and "advantage" in scored.columns and "text" not in scored.columns


def test_evaluation_suite_reads_keys_once(spark):
    comp = spark.createDataFrame(
        [(1, p, "gsm8k", f"Answer: {a}") for p, a in enumerate(["4", "4", "5", "5", "5"])]
        + [(2, p, "arc", f"Answer: {a}") for p, a in enumerate(["B", "B", "A"])],
        "id int, pos int, task string, trace string",
    )
    items = {"gsm8k": spark.createDataFrame([(1, "#### 4")], "id int, answer string"),
             "arc_c": spark.createDataFrame([(2, "B")], "id int, answerKey string")}
    out = PL.evaluation_suite(spark, comp, items, tempfile.mkdtemp(prefix="tf-e2s-"))
    assert "trace" not in out["keys"].columns
    assert {r.bench: r.acc for r in out["accuracy"].collect()} == {"gsm8k": 0.0, "arc_c": 1.0}
    sweep = {r.k: (r.arc_c, r.gsm8k) for r in out["k_sweep"].collect()}
    assert sweep[1] == (1.0, 1.0) and sweep[4] == (None, 1.0) and sweep[2] == (1.0, 1.0)


def test_cli_distill_and_evaluate(spark, capsys):
    from thinkframe.plans import cli

    d = tempfile.mkdtemp(prefix="tf-cli-")
    _write_records(f"{d}/gsm8k.jsonl", "gsm8k", ["#### 4"] * 10, [["4", "5"]] * 10)
    assert cli.main(["distill", "--shard", f"gsm8k={d}/gsm8k.jsonl", "--out", f"{d}/out", "--eval-frac", "0.2"],
                    spark=spark) == 0
    assert "gsm8k: kept 10/20 traces (50.0%)" in capsys.readouterr().out
    assert spark.read.json(f"{d}/out/train").count() == 8
    spark.createDataFrame([(1, 0, "gsm8k", "Answer: 4")], "id int, pos int, task string, trace string") \
        .write.parquet(f"{d}/comp.parquet")
    spark.createDataFrame([(1, "#### 4")], "id int, answer string").write.parquet(f"{d}/items.parquet")
    assert cli.main(["evaluate", "--completions", f"{d}/comp.parquet", "--items", f"gsm8k={d}/items.parquet",
                     "--out", f"{d}/runs", "--model", "m"], spark=spark) == 0
    assert "gsm8k acc = 1.0000 (1/1)" in capsys.readouterr().out


def test_cli_rewards(spark, capsys):
    from thinkframe.plans import cli

    d = tempfile.mkdtemp(prefix="tf-cli-")
    spark.createDataFrame([(1, 0, "<think>x</think>\nAnswer: 4"), (1, 1, "Answer: 5")],
                          "prompt_id int, pos int, text string").write.parquet(f"{d}/comp.parquet")
    spark.createDataFrame([(1, "4", "gsm8k")], "prompt_id int, gold string, task string").write.parquet(f"{d}/p.parquet")
    assert cli.main(["rewards", "--completions", f"{d}/comp.parquet", "--prompts", f"{d}/p.parquet",
                     "--out", f"{d}/scored"], spark=spark) == 0
    rows = {r.pos: (r.r_correctness, r.advantage > 0) for r in spark.read.parquet(f"{d}/scored").collect()}
    assert rows == {0: (1.0, True), 1: (0.0, False)}


def test_meta_gold_reaches_the_rl_prompts_and_shards_share_a_task(spark):
    import pytest

    d = tempfile.mkdtemp(prefix="tf-e1-")
    for i in range(2):
        with open(f"{d}/s{i}.jsonl", "w") as f:
            f.write(json.dumps({"id": f"{i}", "question": f"q{i}", "gold": "4", "traces": [f"{BODY}\nAnswer: 4"],
                                "meta": {"gold": f"four{i}", "extra": {"nested": 1}}}) + "\n")
    shards = [("gsm8k", io.read_jsonl(spark, f"{d}/s{i}.jsonl", io.TEACHER_RECORD)) for i in range(2)]
    out = PL.distill_and_build(spark, shards, f"{d}/out", eval_frac=0.0)
    assert sorted(r.gold for r in out["rl_prompts"].collect()) == ["four0", "four1"]
    assert [(r.task, r.seen, r.kept) for r in out["keep_rate"].collect()] == [("gsm8k", 2, 2)]
    with pytest.raises(ValueError, match="source order"):
        PL.distill_and_build(spark, [("gsm8k", shards[0][1].drop(*io.SOURCE_ORDER))], f"{d}/again")
