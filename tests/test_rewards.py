import pytest
from pyspark.sql import functions as F

from thinkframe.functions import rewards as R
from thinkframe.operators import rewards as RW


def score(spark, texts, golds=None, tasks=None, specs=None):
    n = len(texts)
    golds = golds or ["x"] * n
    tasks = tasks or ["gsm8k"] * n
    df = spark.createDataFrame(
        [(i, t, g, k) for i, (t, g, k) in enumerate(zip(texts, golds, tasks))],
        "i int, text string, gold string, task string",
    )
    return [r.reward for r in RW.score(df, specs).orderBy("i").collect()]


def test_correctness(spark):
    got = score(spark, ["Answer: 4", "Answer: 8"], ["4", "9"], specs=[("correctness", 1.0, {})])
    assert got == [1.0, 0.0]
    assert score(spark, ["Answer: B"], ["B"], ["arc"], specs=[("correctness", 1.0, {})]) == [1.0]


def test_correctness_requires_gold_and_task(spark):
    c = spark.createDataFrame([("p", "Answer: 1")], "prompt_id string, text string")
    p = spark.createDataFrame([("p", "math")], "prompt_id string, task string")
    with pytest.raises(ValueError):
        RW.attach_prompts(c, p)
    p2 = spark.createDataFrame([("p", "1", "math")], "prompt_id string, answer string, task string")
    assert RW.attach_prompts(c, p2).select("gold").first()[0] == "1"


def test_message_shape(spark):
    df = spark.createDataFrame(
        [([("assistant", "Answer: 4")], "4", "gsm8k")],
        "messages array<struct<role:string,content:string>>, gold string, task string",
    )
    out = RW.score(df, [("correctness", 1.0, {})], text=None, messages="messages")
    assert out.first().reward == 1.0


def test_answer_present(spark):
    assert score(spark, ["blah blah\nAnswer: 7", "no marker"], specs=[("answer_present", 1.0, {})]) == [0.1, 0.0]


def test_length_penalty(spark):
    spec = [("length_penalty", 1.0, {"soft_max": 100, "hard_max": 200, "min_reward": -1.0})]
    got = score(spark, ["x" * 200, "x" * 1200, "x" * 600], specs=spec)
    assert got[0] == 0.0 and got[1] == -1.0 and -0.6 < got[2] < -0.4
    spec2 = [("length_penalty", 1.0, {"soft_max": 10, "hard_max": 20, "min_reward": -1.0})]
    assert score(spark, ["y" * 120], specs=spec2) == [-1.0]


def test_format(spark):
    got = score(spark, ["<think>2+2=4</think>\nAnswer: 4", "Answer: 4", "</think>", "Answer: 3 </think> x"],
                specs=[("format", 1.0, {})])
    # both tags and a line: .15 + .1; a line: .1; close tag only, no line: -.05 - .05;
    # close tag only, line before it: -.05 + .1 - .1 - .05
    assert got == pytest.approx([0.25, 0.1, -0.1, -0.1])


def test_registry(spark):
    with pytest.raises(KeyError, match="nope"):
        R.Term(("nope", 1.0, {}))
    with pytest.raises(TypeError, match="soft_max"):
        R.Term({"name": "format", "kwargs": {"soft_max": 3}})
    term = R.Term({"name": "length_penalty", "kwargs": {"soft_max": 1, "hard_max": 2}})
    assert (term.weight, term.parameters) == (1.0, {"soft_max": 1, "hard_max": 2})
    df = spark.createDataFrame([("x" * 400, True)], "t string, ok boolean")
    assert df.select(term.column(text=F.col("t"))).first()[0] == -0.5
    assert df.select(R.Term(("correctness", 2, {})).column(correct=F.col("ok"))).first()[0] == 1.0


@pytest.fixture()
def registered():
    def shout(text, level, floor=0.0):
        return (text.str.count("!") * level).clip(lower=floor)

    R.register("shout", shout, reads=["text", "level"], parameters=["floor"])
    yield
    R.unregister("shout")


def test_registered_rewards_are_checked_when_they_are_made(registered):
    with pytest.raises(ValueError, match="taken"):
        R.register("shout", lambda text: text)
    with pytest.raises(ValueError, match="taken"):
        R.register("format", lambda text: text)
    with pytest.raises(ValueError, match="identifier"):
        R.register("no name", lambda text: text)
    with pytest.raises(ValueError, match="no column"):
        R.register("nothing", lambda: 0, reads=[])
    with pytest.raises(TypeError, match="does not take"):
        R.register("wrong", lambda text: text, reads=["text", "level"])
    with pytest.raises(TypeError, match="does not take"):
        R.register("wrong", lambda text: text, parameters=["floor"])
    with pytest.raises(ValueError, match="native"):
        R.unregister("format")
    with pytest.raises(KeyError, match="native: .*format.*registered: shout"):
        R.Term(("nope", 1.0, {}))
    with pytest.raises(TypeError, match="soft_max"):
        R.Term({"name": "shout", "kwargs": {"soft_max": 3}})
    assert R.names()["registered"] == ["shout"]


def test_registered_reward_beside_native_ones(spark, registered):
    rows = [("p", i, "<think>a</think>\nAnswer: 4" + "!" * i, "4", "gsm8k", i - 1) for i in range(4)] + [("p", 9, None, "4", "gsm8k", 1)]
    df = spark.createDataFrame(rows, "prompt_id string, pos int, text string, gold string, task string, level int")
    specs = [("correctness", 1.0, {}), {"name": "shout", "weight": 0.5, "kwargs": {"floor": -0.25}}, ("answer_present", 1.0, {})]
    out = RW.score(df, specs)
    assert out.columns == [*df.columns, "r_correctness", "r_shout", "r_answer_present", "reward"]
    for r in out.where("text IS NOT NULL").collect():
        assert r["r_shout"] == max(-0.25, r["pos"] * (r["pos"] - 1)) and r["r_answer_present"] == 0.1
        assert r["reward"] == r["r_correctness"] + 0.5 * r["r_shout"] + 0.1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # once, though the sum and the column both use it
    with pytest.raises(ValueError, match="level"):
        RW.score(df.drop("level"), specs)


def test_registered_reward_must_return_a_value_per_row(spark):
    R.register("short", lambda text: text.iloc[:1])
    try:
        df = spark.createDataFrame([("p", i, "x", "4", "gsm8k") for i in range(4)], "prompt_id string, pos int, text string, gold string, task string").coalesce(1)
        with pytest.raises(Exception, match="returned 1 values for 4 rows"):
            RW.score(df, [("short", 1.0, {})]).collect()
    finally:
        R.unregister("short")


def test_mix_and_advantage(spark):
    df = spark.createDataFrame(
        [("p1", 0, "<think>a</think>\nAnswer: 4", "4", "gsm8k"),
         ("p1", 1, "<think>a</think>\nAnswer: 5", "4", "gsm8k"),
         ("p2", 0, "Answer: 4", "4", "gsm8k")],
        "prompt_id string, pos int, text string, gold string, task string",
    )
    out = RW.group_advantage(RW.score(df), "prompt_id").orderBy("prompt_id", "pos").collect()
    r0 = 1.0 * 1.0 + 0.2 * 0.25 + 0.1 * 0.0 + 0.05 * 0.1
    assert out[0].reward == r0
    assert out[0].advantage > 0 > out[1].advantage
    assert out[2].advantage is None  # a one-sample group has no sample std


def test_reward_stack_smoke_lines(spark):
    """The three reward lines of the reference's CPU smoke run."""
    texts = ["<think>2+2=4</think> Answer: 4", "<think>bad</think> Answer: 5", "Answer: 4"]
    df = spark.createDataFrame([(i, t, "4", "gsm8k") for i, t in enumerate(texts)],
                               "i int, text string, gold string, task string")
    specs = [("correctness", 1.0, {}), ("format", 1.0, {}), ("length_penalty", 1.0, {})]
    got = [(r.r_correctness, round(r.r_format, 2), r.r_length_penalty)
           for r in RW.score(df, specs).orderBy("i").collect()]
    assert got == [(1.0, 0.25, 0.0), (0.0, 0.25, 0.0), (1.0, 0.10, 0.0)]
