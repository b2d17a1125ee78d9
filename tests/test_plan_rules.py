"""Design rules checked on the physical plan of every registered query, and of
every public Column function."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from thinkframe.functions import rewards as R
from thinkframe.functions import text as T
from thinkframe.operators import distill as D
from thinkframe.operators import encode as E
from thinkframe.operators import reports as P
from thinkframe.plans.catalog import QUERIES

FORBIDDEN = {
    "BatchEvalPython": "row-at-a-time Python UDF",
    "ArrowEvalPython": "Python UDF on the main path",
    "CartesianProduct": "cross join",
    "BroadcastNestedLoopJoin": "nested-loop join",
}


# what a user registers is Python of the user's, in Arrow batches
ALLOWED = {"registered_reward": {"ArrowEvalPython"}}


@pytest.fixture()
def strict_codegen(spark):
    old = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    yield spark
    spark.conf.set("spark.sql.codegen.fallback", old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_plan_and_codegen(strict_codegen, name):
    """No Python UDF or cross join, and generated code within JVM method limits
    (no silent interpreted fallback)."""
    df = QUERIES[name](strict_codegen, SF_SMALL)
    plan = strict_codegen._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    for node, why in FORBIDDEN.items():
        assert node in ALLOWED.get(name, ()) or node not in plan, f"{name}: {why} ({node})"
    df.write.format("noop").mode("overwrite").save()


COLUMNS = {
    "pystrip": lambda: T.pystrip("t"), "word_count": lambda: T.word_count("t"), "has_min_words": lambda: T.has_min_words("t", 16),
    "py_float": lambda: T.py_float("t"), "g10": lambda: T.g10(F.col("n").cast("double")), "extract_answer": lambda: T.extract_answer("t"),
    "has_answer_line": lambda: T.has_answer_line("t"), "count_answer_lines": lambda: T.count_answer_lines("t"), "norm_letter": lambda: T.norm_letter("t"),
    "norm_math": lambda: T.norm_math("t"), "gold_after_hashes": lambda: T.gold_after_hashes("t"), "gold_gsm8k": lambda: T.gold_gsm8k("t"),
    "rational": lambda: T.rational("t"), "rationals_equal": lambda: T.rationals_equal(T.rational("t"), T.rational("u")),
    "arc_eval_equal": lambda: T.arc_eval_equal("t", "u"), "gsm8k_eval_equal": lambda: T.gsm8k_eval_equal("t", "u"),
    "approx_tokens": lambda: T.approx_tokens("t"), "approx_tokens_raw": lambda: T.approx_tokens_raw("t"), "dedupe_key": lambda: T.dedupe_key("t", "u"),
    "logprob_weight": lambda: T.logprob_weight("n", "n"), "rl_gold": lambda: T.rl_gold("t", "u"), "completion_text": lambda: T.completion_text("t"),
    "correctness": lambda: R.correctness(F.col("n") > 1), "answer_present": lambda: R.answer_present("t"), "format_reward": lambda: R.format_reward("t"),
    "length_penalty": lambda: R.length_penalty("t"), "teacher_prompt": lambda: D.teacher_prompt("t"), "chat_prompt": lambda: D.chat_prompt("t"),
    "repair_response": lambda: D.repair_response("t", "u"), "byte_ids": lambda: E.byte_ids("t", 64), "three_decimals": lambda: P.three_decimals(F.col("n") / 7),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_column_function_compiles(strict_codegen, name):
    docs = strict_codegen.read.parquet(f"{SF_SMALL}/documents.parquet")
    df = docs.select(F.col("text").alias("t"), F.reverse("text").alias("u"), F.col("doc_id").alias("n"))
    df.select(COLUMNS[name]().alias("x")).write.format("noop").mode("overwrite").save()
