import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from thinkframe.functions import text as T


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_extract_answer_cases(spark):
    cases = {
        "stuff\nAnswer: 42": "42",
        "Answer: C": "C",
        "Answer:  -3.14 units": "-3.14 units",
        "no marker here": None,
        "Answer: \n": "",
        "Answer:\n\nfoo": "foo",
        "Answer: a\rb": "a\rb",
        "Answer: 1\nAnswer: 2": "1",
        "answer - x\u2028y": "x\u2028y",
        "Answer:\u00a0 7\u00a0": "7",
    }
    got = one_col(spark, list(cases), T.extract_answer)
    assert got == list(cases.values())


def test_extract_last_variant(spark):
    assert one_col(spark, ["Answer: 1\nAnswer: 2"], lambda c: T.extract_answer(c, which="last")) == ["2"]


def test_norm_letter(spark):
    vals = ["A", "(b)", "the answer is c.", "zzz", "the", "éa b", "Answer C is best", "1"]
    got = one_col(spark, vals, T.norm_letter)
    assert got == ["A", "B", "C", None, None, "B", "C", None]


def test_norm_math(spark):
    vals = ["\\boxed{7}", "$42", "1,234", "7...", " \\boxed{1/2}. ", "(1,2)"]
    got = one_col(spark, vals, T.norm_math)
    assert got == ["7", "42", "1234", "7", "1/2", "(12)"]


def test_g10_matches_python(spark):
    xs = [0.0, -0.0, 1.0, 42.0, 0.25, -3.5, 1e20, 1e-5, 0.0001234, 1234567890.0, 12345678901.0,
          123456.789, 1 / 3, -2 / 3, 9.999999999e9, 1e100, 2.5e-300, float("inf"), float("-inf")]
    got = one_col(spark, xs, T.g10, "double")
    assert got == [f"{x:.10g}" for x in xs]
    assert one_col(spark, [float("nan")], T.g10, "double") == ["nan"]
    # known limit: Java formats from the shortest decimal form, Python from the
    # exact binary value; they differ for subnormals such as 5e-324



def test_py_float_refuses_what_python_refuses(spark):
    vals = ["1d", "0x1p3", "1.0f", "1e5", "inf", "-Infinity", ".5", "5.", "abc", "", "1_000", "1__0", "_1", "1_", "1_0.2_5", "1e1_0",
            "\u0663\u0664", "\uff11\uff0e5", "\U0001d7d8\U0001d7d9", "--1", "+nan", "1_0_0_0"]
    got = one_col(spark, vals, T.py_float)
    expect = []
    for v in vals:
        try:
            expect.append(float(v))
        except ValueError:
            expect.append(None)
    assert list(map(repr, got)) == list(map(repr, expect))


def test_vote_key_numeric_forms(spark):
    df = spark.createDataFrame(
        [("42", "gsm8k"), ("42.0", "gsm8k"), ("$42", "gsm8k"), ("-0.0", "math"), ("3/4", "math"),
         ("(b)", "arc"), (" Foo ", "generic"), (None, "gsm8k")],
        "p string, task string",
    )
    got = [r[0] for r in T.with_vote_key(df, "p", "task", "k").select("k").collect()]
    assert got == ["42", "42", "42", "-0", "3/4", "B", "foo", None]


def test_strip_and_words_follow_python(spark):
    rnd = random.Random(7)
    alphabet = ["a", "b", "é", " ", "\t", "\n", "\u00a0", "\u2003", "\x1c", "\u0085", "\u3000", "x"]
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v string").orderBy("i")
    got = rows(df, T.pystrip("v"), T.word_count("v"), T.has_min_words("v", 3))
    assert got == [(v.strip(), len(v.split()), len(v.split()) >= 3) for v in vals]


def test_gold_gsm8k(spark):
    vals = ["step 1 ... step 2 ... #### 128", "the total is 55 apples", "1,234", "no numbers ", "a #### b #### 7"]
    assert one_col(spark, vals, T.gold_gsm8k) == ["128", "55", "234", "no numbers", "7"]


def _correct(spark, triples):
    df = spark.createDataFrame(triples, "p string, g string, t string")
    return [r[0] for r in T.with_is_correct(df, "p", "g", "t", "c").select("c").collect()]


def test_is_correct_cases(spark):
    triples = [
        ("C", "C", "arc"), ("Answer C is best", "C", "arc"), ("A", "C", "arc"),
        ("42", "The answer is #### 42", "gsm8k"), ("$42.00", "42", "gsm8k"), ("41", "42", "gsm8k"),
        ("\\boxed{7}", "7", "math"), (None, "7", "math"),
        ("1", "2", "arc"),            # Q2: no letter on either side counts as equal
        ("nan", "nan", "gsm8k"),      # NaN never equals NaN
        ("1/2", "0.5", "math"), ("\\frac{1}{2}", "2/4", "math"), ("3/4", "#### 0.75", "gsm8k"),
        (" Foo", "foo ", "generic"),
        ("3.14159265358979323846", "22/7", "math"),   # long decimal: no overflow, not equal
        ("1e400", "1", "gsm8k"),
    ]
    assert _correct(spark, triples) == [True, True, False, True, True, False, True, False, True, False,
                                        True, True, True, True, False, False]


def test_math_equal(spark):
    cases = {
        ("7", "7"): True, ("$7", "7"): True, ("2/2", "1"): True, ("1/3", "0.33"): False,
        ("1234567890/2", "617283945"): True, ("0.12345678901", "0.123456789010"): True, ("0.12345678901", "0.12345678902"): False,
        ("\\frac{12345678901}{24691357802}", "0.5"): True, ("-0", "0"): True, ("-1/2", "0.5"): False, ("007", "7.000"): True,
        ("1/0", "1/0"): True, ("1/0", "2/0"): False, (".", "0"): False, ("5" * 60 + ".0", "5" * 60): True, ("5" * 60, "5" * 59 + "6"): False,
    }
    df = spark.createDataFrame(list(cases), "p string, g string")
    got = {(r.p, r.g): r.e for r in T.with_math_equal(df, "p", "g", "e").collect()}
    assert got == cases


def test_dedupe_key_is_sha1(spark):
    pairs = [("What is 2+2? ", "  <think>x</think>\nAnswer: 4"), ("Émile", "t" * 300)]
    df = spark.createDataFrame(pairs, "q string, t string")
    got = [r[0] for r in df.select(T.dedupe_key(F.col("q"), F.col("t"))).collect()]
    # sha1 of "what is 2+2?\0<think>x</think>\nAnswer: 4" and of "émile\0" + 200 t
    texts = ["what is 2+2?\x00<think>x</think>\nAnswer: 4", "émile\x00" + "t" * 200]
    assert got == [hashlib.sha1(x.encode()).hexdigest() for x in texts]


def test_rl_gold_rstrip_set(spark):
    df = spark.createDataFrame(
        [(None, "x\nAnswer: dime<|im_end|>"), ("7", "x\nAnswer: 3<|im_end|>"), ("", "Answer: 42<|im_end|>")],
        "mg string, r string",
    )
    assert [r[0] for r in df.select(T.rl_gold("mg", "r")).collect()] == ["", "7", "42"]
    assert [r[0] for r in df.select(T.rl_gold("mg", "r", exact_suffix=True)).collect()] == ["dime", "7", "42"]


def test_logprob_weight_and_tokens(spark):
    df = spark.createDataFrame([(-1.0, 2), (-5.0, 0)], "s double, n int")
    got = rows(df, T.logprob_weight("s", "n"))
    assert got[0][0] == pytest.approx(math.exp(-0.5)) and got[1][0] == 1.0
    df2 = spark.createDataFrame([("abc",), ("abcdefghi",), (None,)], "t string")
    assert rows(df2, T.approx_tokens("t"), T.approx_tokens_raw("t")) == [(1, 0), (2, 2), (1, 0)]
