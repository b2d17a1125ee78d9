"""Reports over evaluation rows and completions.

All reports are aggregates with map-side partial combine; the only
per-group collections are report cells (one per model column) and the 40
histogram bins, both bounded by parameters, not by data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinkframe.functions.text import approx_tokens_raw, count_answer_lines, pystrip
from thinkframe.operators.evals import BENCHES
from thinkframe.operators.ordering import exact_quantiles
from thinkframe.session import written

HIST_BINS = 40
# Reference lines drawn on the length histogram (soft and hard length caps).
HIST_MARKS = (512, 1024)


def three_decimals(x) -> Column:
    """``f"{x:.3f}"`` of a double from 0 to 1, rounded from its exact binary
    value (ties to even), as Python does.

    x splits into a high and a low half whose multiples of 2000 are exact, so
    the comparison with the midpoint 2n + 1 is exact too.
    """
    x = F.col(x) if isinstance(x, str) else x
    scaled = x * F.lit(134217729.0)  # 2**27 + 1
    high = scaled - (scaled - x)
    low = x - high
    n = F.floor(x * 1000)
    beyond = (high * 2000 - (n * 2 + 1)) + low * 2000
    n = n + F.when((beyond > 0) | ((beyond == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat((n / 1000).cast("long").cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def bench_report(
    spark: SparkSession,
    results: DataFrame,
    models: Sequence[str] | None = None,
    benches: Sequence[tuple[str, str]] = BENCHES,
    title: str = "# Reasoning post-training results\n",
) -> DataFrame:
    """A9 + J4 + S7: Markdown table of accuracy, bench rows x model columns.

    ``results`` has (bench, model, acc). The expected grid (bench list x
    model list) is left-joined to it; a missing or NULL accuracy prints
    ``n/a``. Without ``models`` every model of the results has a column, by
    name. Returns (line_no, line) rows.
    """
    if models is None:
        models = [r[0] for r in results.select("model").distinct().orderBy("model").collect()]
    grid = spark.createDataFrame(
        [(bi, b, name, mi, m) for bi, (b, name) in enumerate(benches) for mi, m in enumerate(models)],
        "bench_no int, bench string, bench_name string, model_no int, model string",
    )
    r = results.select("bench", "model", F.col("acc").cast("double").alias("acc"))
    cell = F.when(F.col("acc").isNull(), F.lit("n/a")).otherwise(three_decimals("acc"))
    cells = grid.join(r, ["bench", "model"], "left").withColumn("cell", cell)
    by_bench = cells.groupBy("bench_no", "bench_name").agg(F.sort_array(F.collect_list(F.struct("model_no", "cell"))).alias("c"))
    body = by_bench.select(F.col("bench_no") + 3, F.array_insert(F.col("c.cell"), 1, F.col("bench_name")))
    top = spark.createDataFrame([(1, ["bench", *models])], "line_no int, cells array<string>")
    lines = top.union(body).select("line_no", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")).alias("line"))
    fixed = spark.createDataFrame([(0, title), (2, "|---" * (len(models) + 1) + "|")], "line_no int, line string")
    return fixed.union(lines)


def _length_counts(completions: DataFrame, stage: str, text: str) -> DataFrame:
    """(stage, x, n): how many texts of a stage have ``len // 4`` = x; the texts are read once."""
    lengths = completions.select(F.col(stage).alias("stage"), approx_tokens_raw(F.col(text)).cast("long").alias("x"))
    return written(lengths.groupBy("stage", "x").agg(F.count(F.lit(1)).alias("n")), "length-counts")


def summary_of_counts(counts: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """stage, count, mean, std, min, max and the quantiles ``q0`` ... of counted
    values (stage, x, n), whatever the number of distinct ones."""
    n, x = F.col("n"), F.col("x").cast("double")
    total = counts.groupBy("stage").agg(F.sum("n").alias("count"), (F.sum(F.col("x").cast("decimal(19,0)") * n).cast("double") / F.sum("n")).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    of = total.select(F.col("stage").alias("_s"), F.col("mean").alias("_m"))
    spread = counts.join(of, F.col("stage").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(n * (x - F.col("_m")) * (x - F.col("_m"))).alias("_sq"))
    q = exact_quantiles(counts, ["stage"], "x", probs).withColumnRenamed("stage", "_q")
    out = total.join(spread, F.col("stage").eqNullSafe(F.col("_s"))).join(q, F.col("stage").eqNullSafe(F.col("_q")))
    return out.withColumn("std", F.when(F.col("count") > 1, F.sqrt(F.col("_sq") / (F.col("count") - 1)))).drop("_s", "_q", "_sq")


def length_summary(completions: DataFrame, stage: str = "stage", text: str = "trace") -> DataFrame:
    """Count, mean, std, min, quartiles, max of ``len // 4`` per stage."""
    out = summary_of_counts(_length_counts(completions, stage, text))
    return out.select("stage", "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def length_histogram(
    completions: DataFrame, stage: str = "stage", text: str = "trace", bins: int = HIST_BINS
) -> DataFrame:
    """Equal-width bins between each stage's min and max (last bin closed).

    Bin of x = ``bins * (x - lo) div (hi - lo) + 1`` in exact integer
    arithmetic, capped at ``bins``; a stage with a single value puts it in
    the middle bin of a unit-wide range. Every bin is listed, empty ones with
    count 0. The texts are read once, into counts per (stage, length).
    """
    x = _length_counts(completions, stage, text)
    rng = x.groupBy("stage").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = x.join(rng, "stage")
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(bins // 2 + 1)).otherwise(
        F.least(F.lit(bins), F.expr(f"({bins} * (x - lo)) div (hi - lo)") + 1)
    )
    counts = j.groupBy("stage", b.cast("int").alias("bin")).agg(F.sum("n").alias("count"))
    all_bins = rng.select("stage", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    lo_d = F.when(width == 0, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    step = F.when(width == 0, F.lit(1.0 / bins)).otherwise(width / F.lit(float(bins)))
    out = all_bins.join(counts, ["stage", "bin"], "left").select(
        "stage", "bin",
        (lo_d + (F.col("bin") - 1) * step).alias("bin_lo"),
        (lo_d + F.col("bin") * step).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )
    marks = [((F.col("bin_lo") <= m) & (F.lit(m) < F.col("bin_hi"))) for m in HIST_MARKS]
    return out.withColumn("has_mark", marks[0] | marks[1])


# --------------------------------------------------------------------------
# Documented trace-quality figures
# --------------------------------------------------------------------------
def agreement_traps(eval_rows: DataFrame, by: Sequence[str] = ("bench",)) -> DataFrame:
    """Share of items where every sample agrees on a wrong answer."""
    trap = (F.col("support") == F.col("k")) & (F.col("k") > 0) & ~F.col("correct")
    return eval_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(trap).alias("traps"),
    ).withColumn("trap_rate", F.col("traps") / F.greatest(F.col("items"), F.lit(1)))


def answer_thrash(completions: DataFrame, by: Sequence[str] = ("task",), text: str = "trace") -> DataFrame:
    """Share of traces with more than one answer line."""
    multi = count_answer_lines(F.col(text)) > 1
    return completions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("traces"),
        F.count_if(multi).alias("multi_answer"),
    ).withColumn("multi_rate", F.col("multi_answer") / F.greatest(F.col("traces"), F.lit(1)))


def teacher_yield(flagged: DataFrame, teacher: str = "teacher", traces_per_hour: DataFrame | None = None) -> DataFrame:
    """D3: correct-rate per teacher and usable traces per hour (rate x correct-rate).

    ``flagged`` has one row per trace with a boolean ``kept``; the optional
    ``traces_per_hour`` table (teacher, traces_per_hour) gives throughput.
    """
    out = flagged.groupBy(teacher).agg(
        F.count(F.lit(1)).alias("traces"),
        F.count_if(F.col("kept")).alias("correct"),
    ).withColumn("correct_rate", F.col("correct") / F.greatest(F.col("traces"), F.lit(1)))
    if traces_per_hour is not None:
        out = out.join(traces_per_hour, teacher, "left").withColumn(
            "usable_per_hour", F.col("traces_per_hour") * F.col("correct_rate")
        )
    return out


def think_block_rates(completions: DataFrame, by: Sequence[str] = ("task",), text: str = "trace") -> DataFrame:
    """Rate of traces with no think block, and with an empty one."""
    t = F.col(text)
    has_block = t.contains("<think>") & t.contains("</think>")
    inner = F.substring_index(F.substring_index(t, "</think>", 1), "<think>", -1)
    empty = has_block & (F.length(pystrip(inner)) == 0)
    return completions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("traces"),
        F.count_if(~has_block).alias("missing_block"),
        F.count_if(empty).alias("empty_block"),
    ).withColumn("missing_rate", F.col("missing_block") / F.greatest(F.col("traces"), F.lit(1))).withColumn(
        "empty_rate", F.col("empty_block") / F.greatest(F.col("traces"), F.lit(1))
    )


def length_by_step(completions: DataFrame, step: str = "step", text: str = "trace") -> DataFrame:
    """Mean approximate completion length per training step."""
    x = approx_tokens_raw(F.col(text))
    return completions.groupBy(F.col(step).alias("step")).agg(
        F.count(F.lit(1)).alias("completions"), F.avg(x).alias("mean_tokens")
    )
