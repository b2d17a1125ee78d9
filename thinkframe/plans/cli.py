"""Command line for the end-to-end jobs (a thin layer over ``pipelines``).

    python -m thinkframe.plans.cli distill --shard gsm8k=path/gsm8k.jsonl \\
        --shard math=path/math.jsonl --out out/ --per-task-cap 20000 --eval-frac 0.02
    python -m thinkframe.plans.cli evaluate --completions comp.parquet \\
        --items gsm8k=items_gsm8k.parquet --out runs/ --model sft
    python -m thinkframe.plans.cli rewards --completions comp.parquet \\
        --prompts prompts.parquet --out scored/

Inputs ending in ``.jsonl`` / ``.json`` are read as JSON Lines, anything
else as Parquet. The session comes from ``SparkSession.builder`` (cluster
settings such as ``spark.checkpoint.dir`` come from spark-submit).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from thinkframe.plans import pipelines as PL
from thinkframe.sources import io


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    return spark.read.parquet(path)


def _pairs(values: list[str]) -> list[tuple[str, str]]:
    out = []
    for v in values:
        name, _, path = v.partition("=")
        if not path:
            raise SystemExit(f"expected NAME=PATH, got {v!r}")
        out.append((name, path))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="thinkframe")
    sub = ap.add_subparsers(dest="cmd", required=True)

    d = sub.add_parser("distill", help="filter teacher traces and build SFT/RL tables (E1)")
    d.add_argument("--shard", action="append", required=True, help="TASK=teacher_records.jsonl, in order")
    d.add_argument("--out", required=True)
    d.add_argument("--per-task-cap", type=int, default=None)
    d.add_argument("--eval-frac", type=float, default=0.02)
    d.add_argument("--no-eval", action="store_true")
    d.add_argument("--seed", type=int, default=17)
    d.add_argument("--max-trace-chars", type=int, default=6000)
    d.add_argument("--min-trace-tokens", type=int, default=16)

    e = sub.add_parser("evaluate", help="vote over K samples and score benchmarks (E2)")
    e.add_argument("--completions", required=True, help="id, pos, task, trace")
    e.add_argument("--items", action="append", required=True, help="BENCH=items (arc_c, gsm8k, math_500)")
    e.add_argument("--out", required=True)
    e.add_argument("--model", default="model")
    e.add_argument("--k", type=int, default=None)

    r = sub.add_parser("rewards", help="reward columns, mix and group advantages (E3)")
    r.add_argument("--completions", required=True, help="prompt_id, pos, text")
    r.add_argument("--prompts", required=True, help="prompt_id, gold (or answer), task")
    r.add_argument("--out", required=True)

    args = ap.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"thinkframe-{args.cmd}").getOrCreate()

    if args.cmd == "distill":
        shards = []
        for task, path in _pairs(args.shard):
            shards.append((task, io.read_jsonl(spark, path, io.TEACHER_RECORD)))
        out = PL.distill_and_build(
            spark, shards, args.out, args.per_task_cap, args.eval_frac, args.seed, not args.no_eval,
            args.max_trace_chars, args.min_trace_tokens,
        )
        for row in out["keep_rate"].collect():
            print(f"{row.task}: kept {row.kept}/{row.seen} traces ({row.pct:.1f}%)")
    elif args.cmd == "evaluate":
        items = {b: _read(spark, p) for b, p in _pairs(args.items)}
        res = PL.evaluate_benches(_read(spark, args.completions), items, args.out, k=args.k, model=args.model)
        for row in res["accuracy"].orderBy("bench").collect():
            print(f"{row.bench} acc = {row.acc:.4f} ({row.n_correct}/{row.n})")
    else:
        scored = PL.score_rewards(_read(spark, args.completions), _read(spark, args.prompts))
        io.write_table(scored, args.out)
        print(f"wrote rewards to {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
