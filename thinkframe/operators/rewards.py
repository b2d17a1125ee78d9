"""Reward scoring of completions and group-relative advantages.

Plan: completions joined to their prompts on the prompt key (J2; AQE chooses
the join from run-time sizes), one
projection for all reward columns and the weighted total, then the group
statistics as an aggregate joined back. An aggregate (not a window) keeps
a hot prompt from landing in one task: mean and sample std combine
partially map-side, and AQE splits a skewed join partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.functions import rewards as R
from thinkframe.functions.text import completion_text, evaluate_once, extract_answer, with_is_correct
from thinkframe.session import written

ADVANTAGE_EPS = 1e-6


def attach_prompts(completions: DataFrame, prompts: DataFrame, on: str = "prompt_id") -> DataFrame:
    """Completions with gold and task of their prompt.

    Gold falls back to an ``answer`` column; without either (or without
    ``task``) this raises ``ValueError`` before anything runs.
    """
    cols = set(prompts.columns)
    gold = "gold" if "gold" in cols else "answer" if "answer" in cols else None
    if gold is None or "task" not in cols:
        raise ValueError("reward scoring needs 'gold' (or 'answer') and 'task' columns on the prompts")
    p = prompts.select(F.col(on), F.col(gold).alias("gold"), F.col("task"))
    dup = [c for c in ("gold", "task") if c in completions.columns]
    return completions.drop(*dup).join(p, on, "inner")


def score(
    completions: DataFrame,
    specs: Sequence[Mapping | tuple] = R.DEFAULT_MIX,
    text: str | None = "text",
    messages: str | None = None,
    total: str = "reward",
) -> DataFrame:
    """One column per reward (``r_<name>``) and the weighted sum.

    ``completions`` has gold and task (see ``attach_prompts``) and either a
    text column or a chat-messages column (P8). Names are those of the native
    rewards and of registered ones (``functions.rewards.register``), whose
    declared columns must be there (ValueError before anything runs). The
    rewards of a user are evaluated in one pass of Arrow batches, once.
    """
    terms = [R.Term(spec) for spec in specs]
    held = {*completions.columns, "text", "correct"}
    for t in terms:
        if missing := [c for c in t.reward.reads if c not in held]:
            raise ValueError(f"reward {t.name!r} reads {', '.join(missing)}, which the completions do not have")
    df = evaluate_once(completions, _text=completion_text(
        text if text and text in completions.columns else None,
        messages if messages and messages in completions.columns else None,
    ))
    columns = {c: F.col(c) for c in completions.columns} | {"text": F.col("_text")}
    if any("correct" in t.reward.reads for t in terms):
        df = evaluate_once(df, _pred=extract_answer("_text"))
        df = with_is_correct(df, "_pred", "gold", "task", "_ok")
        columns["correct"] = F.col("_ok")
    own = [t for t in terms if not t.reward.native]
    if own:  # a boundary below which Python sees only the columns it reads
        df = evaluate_once(df, **{f"r_{t.name}": t.column(**columns) for t in own})
    native = {t.name: t.column(**columns).alias(f"r_{t.name}") for t in terms if t.reward.native}
    kept = [c for c in df.columns if not c.startswith("r_") or c in completions.columns]
    out = df.select(*kept, *[native.get(t.name, F.col(f"r_{t.name}")) for t in terms])
    mix = F.lit(0.0)
    for i, t in enumerate(terms):
        part = F.lit(t.weight) * F.col(f"r_{t.name}")
        mix = part if i == 0 else mix + part
    return out.withColumn(total, mix).drop("_text", "_pred", "_ok")


def group_advantage(
    scored: DataFrame,
    group: Sequence[str] | str = "prompt_id",
    reward: str = "reward",
    out: str = "advantage",
    columns: Sequence[str] | None = None,
    materialize: bool = True,
) -> DataFrame:
    """``(r - mean) / (std + 1e-6)`` within each group, sample std.

    A one-row group has no sample std: the advantage is NULL. ``columns``
    selects what to carry (default: all); the carried columns are written
    once, so the rewards are not computed again for the statistics side.
    """
    keys = [group] if isinstance(group, str) else list(group)
    if columns is not None:
        carried = list(dict.fromkeys([*keys, *columns, reward]))
        scored = scored.select(*carried)
    if materialize:
        scored = written(scored, "scored-groups")
    stats = scored.groupBy(*keys).agg(
        F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std")
    )
    j = scored.join(stats, keys, "inner")
    adv = (F.col(reward) - F.col("_mean")) / (F.col("_std") + F.lit(ADVANTAGE_EPS))
    return j.withColumn(out, adv).drop("_mean", "_std")
