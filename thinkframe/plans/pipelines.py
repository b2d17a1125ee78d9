"""End-to-end jobs: distil and build (E1), evaluate (E2), reward scoring.

Each job reads tables, runs the operators and writes its outputs. Stage
boundaries are the exchanges inside the operators; what several passes need
(keys, hashes, evaluated rows) is written to the shared checkpoint folder, so a lost executor costs a
recomputation of the lost partitions, not of the whole job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from thinkframe.functions import rewards as R
from thinkframe.operators import distill as D
from thinkframe.operators import evals as V
from thinkframe.operators import reports as P
from thinkframe.operators import rewards as RW
from thinkframe.operators.vote import DEFAULT_STRATEGY, sample_keys
from thinkframe.session import written
from thinkframe.sources import io


def distill_and_build(
    spark: SparkSession,
    shards: Sequence[tuple[str, DataFrame]],
    out_dir: str,
    per_task_cap: int | None = None,
    eval_frac: float = 0.02,
    seed: int = 17,
    with_eval: bool = True,
    max_trace_chars: int = D.DEFAULT_MAX_TRACE_CHARS,
    min_trace_tokens: int = D.DEFAULT_MIN_TRACE_TOKENS,
    symbolic: bool = False,
) -> dict[str, DataFrame]:
    """Teacher records per task -> verified traces -> SFT train/eval + RL prompts.

    ``shards``: (task, records) pairs in shard order; records have id,
    question, gold, traces (array) and optionally a string-map ``meta``, which
    is passed on whole, plus the source-order columns of ``read_jsonl`` (or a
    ``src_pos`` of the caller's; without any ValueError is raised, since an
    invented order would not survive a retry). Writes ``filtered/`` (partitioned by
    task), ``train/``, ``eval/``, ``rl_prompts/`` as JSON Lines and the keep
    rates; returns the DataFrames.
    """
    filtered_parts, observed = [], []
    placed = [c for c in io.SOURCE_ORDER if all(c in records.columns for _, records in shards)]
    if "src_pos" not in placed:
        raise ValueError("records need their source order: read them with read_jsonl, or add src_pos")
    for shard_no, (task, records) in enumerate(shards):
        records = io.spread(records, *placed)
        flat = D.explode_records(records).withColumn("task", F.lit(task))
        flagged = D.flag_traces(flat, max_trace_chars, min_trace_tokens, symbolic)
        # A1 in the same pass as the write: seen/kept are observed, not recomputed
        obs = Observation(f"keep_rate_{shard_no}")
        flagged = flagged.observe(obs, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("kept")).alias("kept_n"))
        observed.append((task, obs))
        kept = D.kept_rows(flagged, keep_cols=[*placed, "pos"])
        filtered_parts.append(kept.withColumn("shard_no", F.lit(shard_no)))
    filtered = filtered_parts[0]
    for part in filtered_parts[1:]:
        filtered = filtered.unionByName(part)
    filtered = filtered.withColumn("task", D.task_of("meta"))
    io.write_table(filtered, f"{out_dir}/filtered", partition_by=["task"])
    filtered = spark.read.parquet(f"{out_dir}/filtered")
    stats = [(t, o.get["seen"], o.get["kept_n"]) for t, o in observed]
    keep = spark.createDataFrame(stats, "task string, seen long, kept long")
    keep = keep.groupBy("task").agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept")).withColumn(
        "pct", F.col("kept") * 100.0 / F.greatest(F.col("seen"), F.lit(1))
    )

    order = ["shard_no", *placed, "pos"]
    built = D.build_dataset(filtered.drop("task"), order, per_task_cap, eval_frac, seed, with_eval)
    # rendered once; the three outputs and the counts read this table
    split = written(built.select("key", *order, "prompt", "response", "task", "meta", "shuffle_pos", "split"), "sft-rows")
    cols = ["prompt", "response", "task", "meta"]
    train = split.where(F.col("split") == "train")
    ev = split.where(F.col("split") == "eval")
    io.write_jsonl(train, f"{out_dir}/train", order_by=["shuffle_pos"], columns=cols)
    if with_eval:
        io.write_jsonl(ev, f"{out_dir}/eval", order_by=["shuffle_pos"], columns=cols)
    rl = written(D.rl_prompts(train), "rl-prompts")
    io.write_jsonl(rl, f"{out_dir}/rl_prompts", order_by=["shuffle_pos"], columns=["prompt", "gold", "task"])
    return {"filtered": filtered, "split": split, "rl_prompts": rl, "keep_rate": keep,
            "rows_by_task": D.rows_by_task(split)}


def evaluate_benches(
    completions: DataFrame,
    items: Mapping[str, DataFrame],
    out_dir: str | None = None,
    strategy: str | Mapping[str, str] = DEFAULT_STRATEGY,
    weight=None,
    k: int | None = None,
    model: str = "model",
) -> dict[str, DataFrame]:
    """Vote K samples per item, score per benchmark, write rows and summaries."""
    rows = written(V.evaluate(completions, items, strategy, weight, k), "eval-rows")  # one vote over the texts
    if out_dir:
        for bench in items:
            io.write_eval(rows.where(F.col("bench") == bench), f"{out_dir}/{bench}.{model}")
    return {"rows": rows, "accuracy": V.accuracy(rows)}


def evaluation_suite(
    spark: SparkSession,
    completions: DataFrame,
    items: Mapping[str, DataFrame],
    work_dir: str,
    strategy: str | Mapping[str, str] = DEFAULT_STRATEGY,
    weight=None,
    ks: Sequence[int] = V.SWEEP_KS,
) -> dict[str, DataFrame]:
    """E2 over one pass of the texts: answers are extracted and normalised once.

    The narrow (id, pos, task, key, weight) table is written to
    ``work_dir/keys``; eval rows, accuracy, the K-sweep and the
    agreement-trap rate all read that table, never the completion text.
    """
    keys_path = f"{work_dir}/keys"
    completions = io.spread(completions, "id", "pos")
    strategy = strategy if weight is not None else "majority"  # equal weights: counts
    io.write_table(sample_keys(completions, ("id",), weight=weight), keys_path)
    keys = spark.read.parquet(keys_path)
    rows = V.evaluate_keys(keys, items, strategy)
    return {
        "keys": keys,
        "rows": rows,
        "accuracy": V.accuracy(rows),
        "k_sweep": V.k_sweep_keys(keys, items, ks, strategy),
        "agreement_traps": P.agreement_traps(rows),
    }


def report(spark: SparkSession, results_dir: str, models: Sequence[str]) -> DataFrame:
    """A9 over written eval summaries (missing runs print n/a)."""
    return P.bench_report(spark, io.read_eval_results(spark, results_dir), models)


def score_rewards(
    completions: DataFrame,
    prompts: DataFrame,
    specs=R.DEFAULT_MIX,
    on: str = "prompt_id",
    text: str | None = "text",
    messages: str | None = None,
) -> DataFrame:
    """Rewards, weighted mix and group-relative advantage per prompt."""
    joined = RW.attach_prompts(completions, prompts, on)
    scored = RW.score(joined, specs, text=text, messages=messages)
    narrow = [c for c in scored.columns if c not in {text, messages, "gold"}]
    return RW.group_advantage(scored, on, columns=narrow)
