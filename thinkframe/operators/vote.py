"""Self-consistency votes over K samples per item.

Shape of the plan: the regex work (answer extraction, vote key) runs in the
scan stage; the first aggregation collapses samples to one row per
(item, key) with map-side partial aggregation, so a hot item or a hot
answer shrinks before the shuffle; the second aggregation picks the winner
per item from at most "distinct answers" rows. No window, no self-join, no
collect of raw samples.

Tie rule: largest score, then the key whose first sample came earliest
(``pos``), as ``Counter.most_common`` / ``max`` over insertion order do.
Weighted scores are exact sums rounded once (``functions.sums``): whatever
order rows arrive in, and with at most 67 numbers per answer of an item,
however many samples it has. A NaN weight counts as largest.

Votes over the first k samples, for any ks, come from one table of leader
changes (``leader_changes``): a row where an item's winner becomes another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.functions import sums
from thinkframe.functions.text import col, evaluate_once, extract_answer, with_vote_key
from thinkframe.operators.prefix import running

# Vote strategy per task used by the evaluation configs (fixed values).
DEFAULT_STRATEGY = {"arc": "majority", "gsm8k": "weighted", "math": "weighted"}


def sample_keys(
    samples: DataFrame,
    id_cols: Sequence[str] = ("id",),
    task: str = "task",
    trace: str = "trace",
    pos: str = "pos",
    weight: Column | str | None = None,
    pred: Column | str | None = None,
) -> DataFrame:
    """One row per sample: ids, task, pos, normalised key (NULL = no answer), weight."""
    answer = col(pred) if pred is not None else extract_answer(trace)
    w = col(weight) if weight is not None else F.lit(1.0)
    s = samples.select(
        *[F.col(c) for c in id_cols],
        F.col(task).alias("task"),
        F.col(pos).alias("pos"),
        answer.alias("answer"),
        w.cast("double").alias("w"),
    )
    s = with_vote_key(s, "answer", "task", "_key").drop("answer")
    # a later filter on the key (e.g. "has an answer") must not be pushed into
    # the staged rules above, which would inline them into one predicate
    return evaluate_once(s, key=F.col("_key")).drop("_key")


def key_counts(keys: DataFrame, id_cols: Sequence[str] = ("id",), weighted: Column | None = None) -> DataFrame:
    """Per (item, key): sample count, first position and, for rows where
    ``weighted`` holds, the exact weight sum (NULL key = no answer)."""
    ids = [F.col(c) for c in id_cols]
    if weighted is None:
        return keys.groupBy(*ids, "task", "key").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    w = F.when(weighted, F.col("w"))
    per_bin = keys.groupBy(*ids, "task", "key", sums.bin_of(w).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"), F.sum(sums.amount(w)).alias("amount"), F.sum(sums.odd(w)).alias("odd"),
    )
    pairs = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "amount")))  # a pair per bin, 67 at most
    out = per_bin.groupBy(*ids, "task", "key").agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"), pairs.alias("pairs"), F.sum("odd").alias("odd"))
    return out.select(*ids, "task", "key", "cnt", "first_pos", sums.rounded("pairs", "odd").alias("wsum"))


def _is_weighted(strategy: str | Mapping[str, str]) -> Column | None:
    """Whether a row's task votes by weight; None if no task does."""
    if isinstance(strategy, str):
        return F.lit(True) if strategy == "weighted" else None
    tasks = [t for t, s in strategy.items() if s == "weighted"]
    return F.coalesce(F.col("task").isin(tasks), F.lit(False)) if tasks else None


def distribution_table(keys: DataFrame, id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """A5 in relational form: one row per (item, answer key) with its count."""
    kc = key_counts(keys, id_cols).where(F.col("key").isNotNull())
    return kc.select(*id_cols, "key", F.col("cnt").alias("count"))


def vote_keys(
    keys: DataFrame,
    id_cols: Sequence[str] = ("id",),
    strategy: str | Mapping[str, str] = "majority",
    distribution: bool = False,
) -> DataFrame:
    """Vote over a ``sample_keys`` table.

    ``strategy`` is ``"majority"``, ``"weighted"``, or a mapping task ->
    strategy (A7). Output: ids, task, answer, support, total, confidence, and
    with ``distribution=True`` a map key -> count, one entry per distinct
    answer of the item: for items of bounded K only, else use
    ``distribution_table``, whose rows stay apart.
    """
    ids = [F.col(c) for c in id_cols]
    weighted = _is_weighted(strategy)
    per_key = key_counts(keys, id_cols, weighted)
    score = F.col("cnt").cast("double")
    if weighted is not None:
        score = F.when(weighted, F.col("wsum")).otherwise(score)
    has_key = F.col("key").isNotNull()
    order = F.when(has_key, F.struct(score.alias("s"), (-F.col("first_pos")).alias("p")))
    winner = F.max_by(F.struct(F.col("key").alias("k"), F.col("cnt").alias("c")), order)
    entries = F.collect_list(F.when(has_key, F.struct(F.col("key").alias("key"), F.col("cnt").alias("value"))))
    aggs = [winner.alias("win"), F.sum("cnt").alias("total")]
    if distribution:
        aggs.append(entries.alias("entries"))
    out = per_key.groupBy(*ids, "task").agg(*aggs)
    support = F.coalesce(F.col("win.c"), F.lit(0)).cast("long")
    total = F.col("total").cast("long")
    return out.select(
        *ids,
        "task",
        F.col("win.k").alias("answer"),
        support.alias("support"),
        total.alias("total"),
        F.when(total > 0, support / total).otherwise(F.lit(0.0)).alias("confidence"),
        *([F.map_from_entries("entries").alias("distribution")] if distribution else []),
    )


def _scores(keys: DataFrame, ids: Sequence[str], weighted: Column | None, last: int | None) -> DataFrame:
    """(ids, task, key, pos, score, first): the score of its answer right after
    each sample with an answer, and the position of the answer's first one."""
    item = [*ids, "task", "key"]
    seen = running(keys.where(F.col("key").isNotNull()), item, "pos", {"n": ("sum", F.lit(1)), "first": ("min", F.col("pos"))}, last=last)
    score = F.col("n").cast("double")
    if weighted is None:
        return seen.select(*item, "pos", score.alias("score"), "first")
    # every sample meets the bins its answer has weights in; a bin's running sum is exact
    own = seen.where(weighted).select(*item, "pos", "first", F.col("w"), sums.bin_of(F.col("w")).alias("bin"), sums.amount(F.col("w")).alias("amount"))
    bins = own.groupBy(*item).agg(F.collect_set("bin").alias("bins"))
    spread = own.join(bins, item).select(*item, "pos", "first", "w", F.explode_outer("bins").alias("b"), F.when(F.col("bin") == F.col("b"), F.col("amount")).alias("amount"))
    summed = running(spread, [*item, "b"], "pos", {"upto": ("sum", F.col("amount")), "odd": ("sum", sums.odd(F.col("w")))}, last=last)
    pairs = F.collect_list(F.when(F.col("b").isNotNull() & F.col("upto").isNotNull(), F.struct(F.col("b").alias("bin"), F.col("upto").cast(sums.AMOUNT).alias("amount"))))
    total = summed.groupBy(*item, "pos", "first").agg(pairs.alias("pairs"), F.max("odd").alias("odd"))
    total = total.select(*item, "pos", sums.rounded("pairs", "odd").alias("score"), "first")
    return seen.where(~weighted).select(*item, "pos", score.alias("score"), "first").union(total)


def leader_changes(keys: DataFrame, id_cols: Sequence[str] = ("id",), strategy: str | Mapping[str, str] = "majority", last: int | None = None) -> DataFrame:
    """(ids, task, pos, answer): a row for every sample after which the vote over
    an item's samples so far has another winner than before.

    Scores only grow, so the winner so far is the largest (score, earliest
    first sample) seen so far: one running maximum, whatever the number of
    samples. Weights must not be negative (an error at run time). ``last``: the
    largest position, if known (see ``prefix.running``).
    """
    ids = list(id_cols)
    weighted = _is_weighted(strategy)
    if weighted is not None:
        wrong = F.raise_error(F.lit("votes over prefixes need weights that are not negative")).cast("double")
        keys = keys.withColumn("w", F.when(weighted & (F.col("w") < 0), wrong).otherwise(F.col("w")))
    scored = _scores(keys, ids, weighted, last)
    standing = F.struct("score", (-F.col("first")).alias("p"), "key")
    led = running(scored.withColumn("own", standing), [*ids, "task"], "pos", {"before": ("max", F.col("own"))}, then=["key"], own=False, last=last)
    led = led.withColumn("lead", F.greatest("before", "own"))
    return led.where(F.col("before").isNull() | (F.col("lead.key") != F.col("before.key"))).select(*ids, "task", "pos", F.col("lead.key").alias("answer"))


def leaders_at(changes: DataFrame, ks: Sequence[int], id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """(ids, task, k, answer): the winner of each item among its first ``k``
    samples (``pos < k``) for every k; no row before the first answer. One row
    per item and k: accuracies for many ks need none (``evals.k_sweep``)."""
    ids = [*id_cols, "task"]
    wanted = changes.select(*ids).distinct().select(*ids, F.explode(F.array(*[F.lit(int(k) - 1).cast("long") for k in ks])).alias("at"))
    rows = changes.select(*ids, F.col("pos").cast("long").alias("at"), F.lit(0).alias("kind"), "answer").union(
        wanted.select(*ids, "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("answer"))
    )
    last = F.last("answer", ignorenulls=True).over(Window.partitionBy(*ids).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("answer", last).where("kind = 1 AND answer IS NOT NULL").select(*ids, (F.col("at") + 1).alias("k"), "answer")


def vote(
    samples: DataFrame,
    id_cols: Sequence[str] = ("id",),
    task: str = "task",
    trace: str = "trace",
    pos: str = "pos",
    strategy: str | Mapping[str, str] = "majority",
    weight: Column | str | None = None,
    k: int | None = None,
    pred: Column | str | None = None,
    distribution: bool = False,
) -> DataFrame:
    """sample_and_vote over a completions table: first ``k`` samples by ``pos``."""
    if k is not None:
        samples = samples.where(F.col(pos) < k)
    keys = sample_keys(samples, id_cols, task, trace, pos, weight, pred)
    return vote_keys(keys, id_cols, strategy if weight is not None else "majority", distribution)  # equal weights: counts


def majority_vote(samples: DataFrame, **kw) -> DataFrame:
    return vote(samples, strategy="majority", **kw)


def weighted_vote(samples: DataFrame, weight: Column | str | None = None, **kw) -> DataFrame:
    return vote(samples, strategy="weighted", weight=weight, **kw)


def distribution_text(dist) -> Column:
    """Vote distribution as ``key:count`` entries sorted by text, comma-joined."""
    d = col(dist)
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(d), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))),
        ",",
    )
