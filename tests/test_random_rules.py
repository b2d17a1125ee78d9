"""Properties of the text rules on random texts of awkward pieces."""

import random

import pytest
from pyspark.sql import functions as F

from thinkframe.functions import rewards as R
from thinkframe.functions import text as T
from thinkframe.operators import distill as D

PIECES = ["Answer", "answer", "Answer:", "answer -", ": ", ":", "-", " ", "  ", "\n", "\r", "\t", "\u00a0",
          "\u0085", "\u2028", "\u3000", "\x1c", "A", "b", "C", "e", "x", "the", "42", "42.0", "7", "0", "-3",
          "1/2", "2/4", "0.5", "$", ",", "1,234", "\\boxed{", "}", "\\frac{1}{2}", ".", "..", "####", "é", "(", ")",
          "inf", "nan", "1e3", "1d", "0x1p3", "<think>", "</think>"]


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def table(spark, values, name="t"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")


@pytest.mark.parametrize("seed", [2024, 7])
def test_an_appended_answer_is_found_unless_another_comes_first(spark, seed):
    plain = [t for t in texts(seed, 800) if "nswer" not in t]
    body = table(spark, plain).select("t", F.concat("t", F.lit("\nAnswer: 17 \nAnswer: 18")).alias("u"))
    got = body.select(T.extract_answer("t").alias("none"), T.extract_answer("u").alias("a"), T.extract_answer("u", which="last").alias("z"),
                      T.has_answer_line("t").alias("p"), T.has_answer_line("u").alias("q")).collect()
    assert all((r.none, r.a, r.z, r.p, r.q) == (None, "17", "18", False, True) for r in got)


@pytest.mark.parametrize("seed", [99, 12345])
def test_normal_forms_are_stable(spark, seed):
    df = table(spark, texts(seed, 800)).withColumn("n", T.norm_math("t")).withColumn("l", T.norm_letter("t"))
    rows = df.select("n", T.norm_letter("l").alias("ll"), "l", T.pystrip("n").alias("s"), F.col("n").rlike("[$,]").alias("left")).collect()
    for r in rows:
        assert r.ll == r.l and r.s == r.n and not r.left
        assert r.l is None or r.l in "ABCDE"


def test_dressed_up_answers_stay_correct_and_share_a_key(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        n = str(rnd.randint(-9999, 9999))
        dress = rnd.choice(["{}", " {} ", "${}", "{}.", "{}.0", "\\boxed{{{}}}", "{}..", "\u00a0{}\u3000"])
        rows.append((dress.format(n), n, rnd.choice(["gsm8k", "math"])))
    df = spark.createDataFrame(rows, "p string, g string, task string")
    df = T.with_is_correct(df, "p", "g", "task", "ok")
    df = T.with_vote_key(T.with_vote_key(df, "p", "task", "a"), "g", "task", "b")
    assert all(r.ok and r.a == r.b for r in df.collect())


def test_no_prediction_is_never_correct(spark):
    rows = [(None, g, t) for g in ("C", "42", "x", None) for t in ("arc", "gsm8k", "math", "generic")]
    df = spark.createDataFrame(rows, "p string, g string, task string")
    assert not any(r.ok for r in T.with_is_correct(df, "p", "g", "task", "ok").collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_repaired_responses_are_whole(spark, seed):
    df = table(spark, texts(seed, 600)).withColumn("r", D.repair_response("t", F.lit("5")))
    for r in df.collect():
        assert "<think>" in r.r and "</think>" in r.r and "Answer:" in r.r and r.r.endswith("<|im_end|>")
    again = df.select("r", D.repair_response(F.expr("substring(r, 1, length(r) - 10)"), F.lit("5")).alias("rr"))
    assert all(x.r == x.rr for x in again.collect())


def test_format_reward_bounds_and_length_penalty_falls(spark):
    df = table(spark, texts(8, 600)).select(R.format_reward("t").alias("f"), R.answer_present("t").alias("p"))
    for r in df.collect():
        assert -0.21 <= r.f <= 0.25 + 1e-9 and r.p in (0.0, 0.1)
    lengths = [0, 3, 4, 2047, 2048, 2052, 3000, 4095, 4096, 9000]
    got = [r[0] for r in table(spark, ["x" * n for n in lengths]).orderBy("i").select(R.length_penalty("t")).collect()]
    assert got == sorted(got, reverse=True) and got[0] == got[4] == 0.0 and got[5] < 0 and got[-2:] == [-0.5, -0.5]
