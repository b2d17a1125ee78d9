import pytest
from pyspark.sql import functions as F

from thinkframe.operators import evals as V
from thinkframe.operators import reports as P


def test_bench_report_marks_missing(spark):
    res = spark.createDataFrame([("arc_c", "m1", 0.0625), ("gsm8k", "m2", 0.5)], "bench string, model string, acc double")
    lines = [r.line for r in P.bench_report(spark, res, ["m1", "m2"]).orderBy("line_no").collect()]
    assert lines[1:] == [
        "| bench | m1 | m2 |", "|---|---|---|",
        "| ARC-Challenge | 0.062 | n/a |", "| GSM8K | n/a | 0.500 |", "| MATH-500 | n/a | n/a |",
    ]


def test_length_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([("s", "x" * (4 * n)) for n in (0, 10, 20, 40)] + [("t", "abcd")], "stage string, trace string")
    h = {(r.stage, r.bin): r["count"] for r in P.length_histogram(df).collect()}
    assert h[("s", 1)] == 1 and h[("s", 11)] == 1 and h[("s", 21)] == 1 and h[("s", 40)] == 1
    assert sum(v for (s, _), v in h.items() if s == "s") == 4 and len([k for k in h if k[0] == "s"]) == 40
    assert h[("t", 21)] == 1


def test_length_summary(spark):
    import pandas as pd

    xs = [0, 4, 8, 40, 400]
    df = spark.createDataFrame([("s", "x" * n) for n in xs], "stage string, trace string")
    r = P.length_summary(df).first()
    d = pd.Series([n // 4 for n in xs], dtype=float).describe()
    assert (r["count"], r.mean, r.min, r.p25, r.p50, r.p75, r.max) == (
        5, d["mean"], d["min"], d["25%"], d["50%"], d["75%"], d["max"])
    assert abs(r["std"] - d["std"]) < 1e-9


def test_quantiles_of_many_groups_and_values(spark):
    """Against numpy, and without ``percentile`` or an unpartitioned window in the plan."""
    import numpy as np

    from thinkframe.operators.ordering import exact_quantiles

    rng = np.random.default_rng(5)
    rows = [(f"g{g}" if g else None, int(x), int(n)) for g in range(6) for x, n in zip(rng.choice(10**7, 400, replace=False) - 10**6, rng.integers(1, 9, 400), strict=True)]
    rows += [("one", 7, 1), ("same", 3, 1000), ("two", 1, 1), ("two", 2, 1), ("none", None, 5)]
    df = spark.createDataFrame(rows, "g string, x long, n long")
    probs = (0.0, 0.001, 0.25, 1 / 3, 0.5, 0.975, 1.0)
    out = exact_quantiles(df, ["g"], "x", probs)
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in out.collect()}
    assert set(got) == {r[0] for r in rows} - {"none"}
    for g, values in got.items():
        xs = np.repeat([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
        assert values == pytest.approx(list(np.quantile(xs, probs)), rel=1e-12, abs=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan


def test_length_summary_keeps_no_list_of_values(spark):
    df = spark.range(2000).selectExpr("'s' as stage", "repeat('x', int(id * 7 % 4001)) as trace")
    out = P.length_summary(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan and out.first()["count"] == 2000


def test_k_sweep_null_for_missing_k(spark):
    comp = spark.createDataFrame([(1, p, "arc", "Answer: A") for p in range(2)], "id int, pos int, task string, trace string")
    items = {"arc_c": spark.createDataFrame([(1, "A")], "id int, answerKey string")}
    rows = {r.k: r.arc_c for r in V.k_sweep(comp, items, ks=(1, 2, 4)).collect()}
    assert rows == {1: 1.0, 2: 1.0, 4: None}


def test_documented_rates(spark):
    df = spark.createDataFrame(
        [("t", "<think></think>\nAnswer: 1\nAnswer: 2"), ("t", "no block Answer: 3"), ("t", "<think>x</think> Answer: 4")],
        "task string, trace string",
    )
    th = P.answer_thrash(df).first()
    assert (th.traces, th.multi_answer) == (3, 1)
    tb = P.think_block_rates(df).first()
    assert (tb.missing_block, tb.empty_block) == (1, 1)
    rows = spark.createDataFrame([("b", 3, 3, False), ("b", 2, 3, False), ("b", 3, 3, True)],
                                 "bench string, support long, k long, correct boolean")
    assert P.agreement_traps(rows).first().traps == 1
    steps = P.length_by_step(df.withColumn("step", F.lit(1))).first()
    assert steps.completions == 3


def test_per_bench_eval_functions(spark):
    votes = spark.createDataFrame([(1, "A", 2, 3, 0.5), (2, "0.5", 1, 1, 1.0), (3, "42", 1, 1, 1.0)],
                                  "id int, answer string, support long, total long, confidence double")
    arc = V.eval_arc(votes, spark.createDataFrame([(1, " a ")], "id int, answerKey string")).first()
    assert (arc.gold, arc.pred, arc.correct, arc.k) == ("A", "A", True, 3)
    m = V.eval_math(votes, spark.createDataFrame([(2, "1/2", 5, "algebra")],
                                                 "id int, answer string, level int, subject string")).first()
    assert m.correct and m.level == 5 and m.subject == "algebra"
    g = V.eval_gsm8k(votes, spark.createDataFrame([(3, "x #### 42"), (4, "no votes 7")], "id int, answer string"))
    assert {r.id: (r.gold, r.correct, r.k) for r in g.collect()} == {3: ("42", True, 1), 4: ("7", False, 0)}


def test_same_ids_in_two_benchmarks(spark):
    comp = spark.createDataFrame(
        [(1, 0, "arc", "Answer: B"), (1, 0, "gsm8k", "Answer: 7")], "id int, pos int, task string, trace string")
    items = {"arc_c": spark.createDataFrame([(1, "B")], "id int, answerKey string"),
             "gsm8k": spark.createDataFrame([(1, "#### 7")], "id int, answer string")}
    rows = {r.bench: (r.pred, r.correct) for r in V.evaluate(comp, items).collect()}
    assert rows == {"arc_c": ("B", True), "gsm8k": ("7", True)}


def test_three_decimals_as_python_prints_them(spark):
    values = [x / 2000 for x in range(2001)] + [x / 7 for x in range(8)] + [0.5415, 0.1235, 0.4045]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").orderBy("i")
    assert [r[0] for r in df.select(P.three_decimals("x")).collect()] == [f"{x:.3f}" for x in values]


def test_report_lists_every_model_of_the_results(spark):
    res = spark.createDataFrame([("arc_c", "z", 0.5), ("gsm8k", "a.b", 0.25)], "bench string, model string, acc double")
    lines = [r.line for r in P.bench_report(spark, res).orderBy("line_no").collect()]
    assert lines[1] == "| bench | a.b | z |" and lines[3] == "| ARC-Challenge | n/a | 0.500 |"
