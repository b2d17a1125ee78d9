"""Summarise the physical plans of the headline queries (markdown on stdout).

For each query: columns read from parquet, pushed filters, exchanges (with
their partitioning), aggregates and window group limits, joins, and whether
every operator outside the exchanges sits in whole-stage codegen.
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thinkframe.plans import catalog  # noqa: E402
from thinkframe.session import local_session  # noqa: E402

NAMES = ["distill_filter", "per_task_cap", "train_eval_split", "majority_vote", "eval_items", "k_sweep",
         "reward_mix", "group_advantage", "encode_examples", "pad_batches"]


def summarize(plan: str) -> dict:
    reads = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)))
    exchanges = re.findall(r"Arguments: (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition|RoundRobinPartitioning\(\d+\))", plan)
    ops = re.findall(r"^\((\d+)\) (\w+)", plan, flags=re.M)
    names = [o for _, o in ops]
    wgl = re.findall(r"row_number\(\), (\d+), (Partial|Final)", plan)
    joins = [o for o in names if o.endswith("Join")]
    return {
        "reads": reads,
        "exchanges": [re.sub(r"#\d+L?", "", e) for e in exchanges],
        "joins": joins,
        "group_limits": sorted(set(wgl)),
        "aggregates": sum(1 for o in names if o.endswith("Aggregate")),
        "scans": names.count("Scan") + sum(1 for o in names if o.startswith("Scan")),
        "checkpoint_reads": names.count("ExistingRDD") + names.count("Scan ExistingRDD"),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    print(f"# Physical plan summary (sf={sf}, initial AQE plans)\n")
    for name in NAMES:
        df = catalog.QUERIES[name](spark, sf)
        plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        s = summarize(plan)
        print(f"## {name}\n")
        print(f"- parquet reads: {', '.join('`' + r + '`' for r in s['reads']) or 'none (checkpointed input)'}")
        print(f"- exchanges ({len(s['exchanges'])}): {', '.join('`' + e + '`' for e in s['exchanges']) or 'none'}")
        print(f"- aggregates: {s['aggregates']}; joins: {', '.join(s['joins']) or 'none'}")
        if s["group_limits"]:
            print(f"- window group limits: {', '.join(f'row_number<={n} {m}' for n, m in s['group_limits'])}")
        if "ExistingRDD" in plan or "LogicalRDD" in plan:
            print("- reads a checkpointed intermediate (lineage cut)")
        print()


if __name__ == "__main__":
    main()
