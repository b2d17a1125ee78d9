"""Benchmark evaluation over sampled completions.

Completions are an input table (item id, pos, text); the vote runs per item
(see ``vote``), is joined to the benchmark items on ``id`` and compared to
the gold answer with each benchmark's own rule. Items without samples stay
in the result (left join) with a NULL prediction, as an item whose samples
carry no answer does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.functions.text import (
    arc_eval_equal,
    gold_gsm8k,
    gsm8k_eval_equal,
    pystrip,
    with_math_equal,
)
from thinkframe.operators.prefix import running
from thinkframe.operators.vote import DEFAULT_STRATEGY, leader_changes, sample_keys, vote_keys
from thinkframe.session import written

# Benchmark keys and display names, in report order.
BENCHES = (("arc_c", "ARC-Challenge"), ("gsm8k", "GSM8K"), ("math_500", "MATH-500"))
BENCH_TASK = {"arc_c": "arc", "gsm8k": "gsm8k", "math_500": "math"}
SWEEP_KS = (1, 2, 4, 8, 16)

_VOTE_COLS = ["answer", "support", "total", "confidence"]


def _join_votes(items: DataFrame, votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items left-joined to their votes; on (keys, task) when votes carry the task,
    so item ids need only be unique within one benchmark."""
    on = [*keys, "task"] if "task" in votes.columns and "task" in items.columns else list(keys)
    v = votes.select(*on, *_VOTE_COLS)
    return items.join(v, on, "left")


def _rows(j: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return j.select(
        *keys,
        *extra,
        "gold",
        F.col("answer").alias("pred"),
        F.coalesce(F.col("support"), F.lit(0)).cast("long").alias("support"),
        F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("k"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        "correct",
    )


def eval_arc(votes: DataFrame, items: DataFrame, keys: Sequence[str] = ("id",), extra=()) -> DataFrame:
    """``upper(strip(pred or '')) == upper(strip(answerKey))``."""
    return _score_items(_bench_items({"arc_c": items}, keys, extra), votes, keys, extra).drop("bench")


def eval_gsm8k(votes: DataFrame, items: DataFrame, keys: Sequence[str] = ("id",), extra=()) -> DataFrame:
    """X5 gold + X10 equality."""
    return _score_items(_bench_items({"gsm8k": items}, keys, extra), votes, keys, extra).drop("bench")


def eval_math(votes: DataFrame, items: DataFrame, keys: Sequence[str] = ("id",), extra=("level", "subject")) -> DataFrame:
    """X11: normal-form or rational equality of vote and gold."""
    return _score_items(_bench_items({"math_500": items}, keys, extra), votes, keys, extra).drop("bench")


_EVAL = {"arc_c": eval_arc, "gsm8k": eval_gsm8k, "math_500": eval_math}


def _bench_items(items: Mapping[str, DataFrame], keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """All benchmarks' items in one table: keys, extra, bench, gold (per-bench rule)."""
    gold = {
        "arc_c": lambda df: F.upper(pystrip(F.col("answerKey"))),
        "gsm8k": lambda df: gold_gsm8k(F.col("answer")),
        "math_500": lambda df: pystrip(F.col("answer").cast("string")),
    }
    out = None
    for bench in _EVAL:
        if bench not in items:
            continue
        it = items[bench]
        cols = [F.col(c) if c in it.columns else F.lit(None).alias(c) for c in extra]
        part = it.select(*keys, *cols, F.lit(bench).alias("bench"), F.lit(BENCH_TASK[bench]).alias("task"),
                         gold[bench](it).alias("gold"))
        out = part if out is None else out.unionByName(part)
    return out


def _judged(j: DataFrame) -> DataFrame:
    """Rows (bench, gold, answer) with ``correct`` by each benchmark's rule."""
    j = with_math_equal(j, "answer", "gold", "_meq")
    ans, gold = F.col("answer"), F.col("gold")
    correct = (
        F.when(F.col("bench") == "arc_c", arc_eval_equal(ans, gold))
        .when(F.col("bench") == "gsm8k", gsm8k_eval_equal(ans, gold))
        .otherwise(ans.isNotNull() & F.col("_meq"))
    )
    return j.withColumn("correct", correct).drop("_meq")


def _score_items(items_all: DataFrame, votes: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Join votes once and apply each benchmark's equality rule."""
    return _rows(_judged(_join_votes(items_all, votes, keys)), ["bench", *keys], extra)


def evaluate(
    completions: DataFrame,
    items: Mapping[str, DataFrame],
    strategy: str | Mapping[str, str] = DEFAULT_STRATEGY,
    weight=None,
    k: int | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Vote per item and score every benchmark; one row per item with ``bench``.

    ``completions``: id, pos, task, trace (and the weight column if used).
    ``items``: bench key -> items table (arc_c, gsm8k, math_500). Votes are
    computed once and joined once to the union of all items on (id, task), so
    ids need only be unique within a benchmark.
    """
    if k is not None:
        completions = completions.where(F.col("pos") < k)
    strategy = strategy if weight is not None else "majority"  # equal weights: counts
    return evaluate_keys(sample_keys(completions, ("id",), weight=weight), items, strategy, extra)


def evaluate_keys(
    keys: DataFrame,
    items: Mapping[str, DataFrame],
    strategy: str | Mapping[str, str] = DEFAULT_STRATEGY,
    extra: Sequence[str] = (),
) -> DataFrame:
    """``evaluate`` from a narrow ``sample_keys`` table (no text read again)."""
    votes = vote_keys(keys, ("id",), strategy)
    return _score_items(_bench_items(items, ("id",), extra), votes, ("id",), extra)


def accuracy(rows: DataFrame, by: Sequence[str] = ("bench",)) -> DataFrame:
    """``correct / max(n, 1)`` per group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("correct")).alias("n_correct"),
    ).withColumn("acc", F.col("n_correct") / F.greatest(F.col("n"), F.lit(1)))


def k_sweep(
    completions: DataFrame,
    items: Mapping[str, DataFrame],
    ks: Sequence[int] | DataFrame = SWEEP_KS,
    strategy: str | Mapping[str, str] = DEFAULT_STRATEGY,
    weight=None,
) -> DataFrame:
    """A10 + J3: accuracy per K as a K x bench table.

    ``ks``: whole numbers, or a table with a column ``k`` of any length. The
    samples are voted over once (``leader_changes``), a winner is judged where
    it becomes one, and the accuracy of a K is the sum of the changes before
    it; neither samples nor items are multiplied by the Ks. A K larger than
    every item's sample count is reported as NULL, like a missing run.
    """
    strategy = strategy if weight is not None else "majority"  # equal weights: counts
    return k_sweep_keys(sample_keys(completions, ("id",), weight=weight), items, ks, strategy)


def k_sweep_keys(
    keys: DataFrame,
    items: Mapping[str, DataFrame],
    ks: Sequence[int] | DataFrame = SWEEP_KS,
    strategy: str | Mapping[str, str] = DEFAULT_STRATEGY,
) -> DataFrame:
    """``k_sweep`` from a narrow ``sample_keys`` table (keys are extracted once;
    the table is written, as its order of samples is looked at more than once)."""
    spark, item = keys.sparkSession, ["id", "task"]
    benches = [b for b, _ in BENCHES if b in items]
    if not isinstance(ks, DataFrame):
        ks = spark.createDataFrame([(int(k),) for k in ks], "k long")
    ks = ks.select(F.col("k").cast("long").alias("k")).where("k IS NOT NULL").distinct()
    keys = written(keys, "sweep-keys")
    last = keys.agg(F.max("pos")).first()[0] or 0
    wanted = written(_bench_items(items, ("id",), ()), "sweep-items")

    # right winners gained and lost, per bench and position
    changes = leader_changes(keys, ("id",), strategy, last).withColumn("pos", F.col("pos").cast("long"))
    judged = _judged(wanted.join(changes, item)).withColumn("right", F.coalesce(F.col("correct"), F.lit(False)).cast("long"))
    before = F.lag("right", 1, 0).over(Window.partitionBy("bench", *item).orderBy("pos"))
    gains = judged.withColumn("gain", F.col("right") - before).where("gain <> 0")
    gains = gains.groupBy("bench", "pos").agg(F.sum("gain").alias("gain"))
    # as-of: the gains up to position k - 1 for every k
    asked = ks.select(F.explode(F.array(*[F.lit(b) for b in benches])).alias("bench"), (F.col("k") - 1).alias("pos"), F.lit(0).cast("long").alias("gain"), F.lit(1).alias("kind"))
    steps = gains.select("bench", "pos", "gain", F.lit(0).alias("kind")).union(asked)
    summed = running(steps, ["bench"], "pos", {"n_correct": ("sum", F.col("gain"))}, then=["kind"]).where("kind = 1")

    # items per bench, and the longest run of first samples that an item has
    dense = running(keys.select(*item, F.col("pos").cast("long").alias("pos")), item, "pos", {"seen": ("sum", F.lit(1))}, last=last).where("seen > pos")
    longest = dense.groupBy(*item).agg(F.max(F.col("pos") + 1).alias("most"))
    size = wanted.join(longest, item, "left").groupBy("bench").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("most"), F.lit(0)).alias("most"))
    acc = summed.withColumn("k", F.col("pos") + 1).join(size, "bench")
    acc = acc.withColumn("acc", F.when(F.col("k") <= F.col("most"), F.col("n_correct") / F.greatest(F.col("n"), F.lit(1))))
    out = acc.groupBy("k").pivot("bench", benches).agg(F.first("acc"))
    return out.select(F.col("k").cast("int").alias("k"), *benches)
