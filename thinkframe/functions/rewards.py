"""Rule-based rewards as Column functions (R1-R5, U-1).

Each reward maps a completion text column (plus gold/task for correctness)
to a double column. Additions happen in the same order and with the same
double constants as the original scalar code, so sums are bit-identical.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from thinkframe.functions.text import (
    approx_tokens,
    col,
    has_answer_line,
)

# Reward sizes and defaults.
CORRECT_REWARD = 1.0
ANSWER_PRESENT_REWARD = 0.1
FORMAT_BOTH_TAGS = 0.15
FORMAT_CLOSE_ONLY = -0.05
FORMAT_ANSWER_LINE = 0.1
FORMAT_ANSWER_BEFORE_CLOSE = -0.1
FORMAT_NO_ANSWER_AFTER_CLOSE = -0.05
LENGTH_DEFAULTS = {"soft_max": 512, "hard_max": 1024, "min_reward": -0.5}
# Production mix: (name, weight, kwargs)
DEFAULT_MIX = (
    ("correctness", 1.0, {}),
    ("format", 0.2, {}),
    ("length_penalty", 0.1, {"soft_max": 512, "hard_max": 1024, "min_reward": -0.5}),
    ("answer_present", 0.05, {}),
)

THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"


def correctness(correct) -> Column:
    """1.0 where the extracted answer is correct for the task, else 0.0.

    ``correct`` is the verdict column of ``with_is_correct``; the staged rule
    is a DataFrame step (``operators.rewards.score``), not one expression.
    """
    return F.when(col(correct), F.lit(CORRECT_REWARD)).otherwise(F.lit(0.0))


def answer_present(text) -> Column:
    """R2: 0.1 when an answer line is present."""
    return F.when(has_answer_line(text), F.lit(ANSWER_PRESENT_REWARD)).otherwise(F.lit(0.0))


def format_reward(text) -> Column:
    """Think-block symmetry, answer line, and answer placement around ``</think>``."""
    t = col(text)
    has_open, has_close = t.contains(THINK_OPEN), t.contains(THINK_CLOSE)
    head = F.substring_index(t, THINK_CLOSE, 1)
    tail = F.substring(t, F.instr(t, THINK_CLOSE) + len(THINK_CLOSE), 1 << 30)
    r = F.lit(0.0) + F.when(has_open & has_close, F.lit(FORMAT_BOTH_TAGS)).when(
        has_close & ~has_open, F.lit(FORMAT_CLOSE_ONLY)
    ).otherwise(F.lit(0.0))
    r = r + F.when(has_answer_line(t), F.lit(FORMAT_ANSWER_LINE)).otherwise(F.lit(0.0))
    r = r + F.when(has_close & has_answer_line(head), F.lit(FORMAT_ANSWER_BEFORE_CLOSE)).otherwise(F.lit(0.0))
    r = r + F.when(has_close & ~has_answer_line(tail), F.lit(FORMAT_NO_ANSWER_AFTER_CLOSE)).otherwise(
        F.lit(0.0)
    )
    return r


def length_penalty(text, soft_max: int = 512, hard_max: int = 1024, min_reward: float = -0.5) -> Column:
    """0 up to ``soft_max`` approx tokens, linear to ``min_reward`` at ``hard_max``."""
    span = max(1, hard_max - soft_max)
    n = approx_tokens(text)
    return (
        F.when(n <= soft_max, F.lit(0.0))
        .when(n >= hard_max, F.lit(float(min_reward)))
        .otherwise(F.lit(float(min_reward)) * ((n - soft_max) / F.lit(span)))
    )


@dataclass(frozen=True)
class Reward:
    """A registered reward: its Column function, the columns it reads and the
    parameters it may be given. Native rewards read "text" or "correct"."""

    column: Callable[..., Column]
    reads: tuple[str, ...] = ("text",)
    parameters: frozenset = frozenset()
    native: bool = True


REGISTRY: dict[str, Reward] = {
    "correctness": Reward(correctness, reads=("correct",)),
    "answer_present": Reward(answer_present),
    "format": Reward(format_reward),
    "length_penalty": Reward(length_penalty, parameters=frozenset(LENGTH_DEFAULTS)),
}


def register(name: str, function: Callable[..., pd.Series], reads: Sequence[str] = ("text",), parameters: Sequence[str] = ()) -> None:
    """Register a reward of the user's: ``function(*columns, **parameters)``
    takes a pandas Series for each column of ``reads`` and returns one of
    numbers, a batch at a time (Arrow).

    ``reads`` may name "text" (the completion), "correct" (the verdict on its
    answer) and any column of the completions. The name must be new and the
    function must take what is declared, or ValueError or TypeError is raised
    here, before any job.
    """
    if not name.isidentifier() or name in REGISTRY:
        raise ValueError(f"reward name {name!r} is taken" if name in REGISTRY else f"reward name {name!r} is not an identifier")
    if not reads:
        raise ValueError(f"reward {name!r} reads no column")
    try:
        inspect.signature(function).bind(*reads, **dict.fromkeys(parameters))
    except TypeError as error:
        raise TypeError(f"reward {name!r} does not take {len(reads)} columns and {sorted(parameters)}: {error}") from None

    def column(*columns: Column, **given) -> Column:
        @F.pandas_udf("double")
        def scored(*series: pd.Series) -> pd.Series:
            out = function(*series, **given)
            if len(out) != len(series[0]):
                raise ValueError(f"reward {name!r} returned {len(out)} values for {len(series[0])} rows")
            return pd.Series(out, dtype="float64").reset_index(drop=True)

        return scored(*columns)

    REGISTRY[name] = Reward(column, tuple(reads), frozenset(parameters), native=False)


def unregister(name: str) -> None:
    """Take a user's reward out of the registry; native ones stay."""
    if name in REGISTRY and REGISTRY[name].native:
        raise ValueError(f"reward {name!r} is native")
    REGISTRY.pop(name, None)


def names() -> dict[str, list[str]]:
    """Names of the native and of the users' rewards."""
    kinds = {"native": [], "registered": []}
    for name in sorted(REGISTRY):
        kinds["native" if REGISTRY[name].native else "registered"].append(name)
    return kinds


class Term:
    """One weighted term of a reward mix, checked when it is made.

    Given as a mapping (name, and optionally weight and kwargs) or as a
    (name, weight, kwargs) tuple.
    """

    def __init__(self, spec: Mapping | Sequence):
        given = dict(spec) if isinstance(spec, Mapping) else dict(zip(("name", "weight", "kwargs"), spec, strict=True))
        self.name, self.weight = given["name"], float(given.get("weight", 1.0))
        self.parameters = dict(given.get("kwargs") or {})
        self.reward = REGISTRY.get(self.name)
        if self.reward is None:
            there = "; ".join(f"{kind}: {', '.join(own) or 'none'}" for kind, own in names().items())
            raise KeyError(f"no reward is called {self.name!r}; there are {there}")
        if strange := set(self.parameters) - self.reward.parameters:
            raise TypeError(f"reward {self.name!r} takes no {', '.join(sorted(strange))}")

    def column(self, **columns: Column) -> Column:
        """The unweighted reward over the given columns by name."""
        return self.reward.column(*[columns[c] for c in self.reward.reads], **self.parameters)
