"""DataFrame operators: distil/build, votes, evaluation, rewards, reports, encoding."""

from thinkframe.operators.distill import (  # noqa: F401
    arc_question,
    build_dataset,
    cap_per_group,
    chat_prompt,
    dedupe_first,
    explode_records,
    filter_traces,
    flag_traces,
    keep_rate,
    kept_rows,
    merge_task,
    repair_response,
    rl_prompts,
    rows_by_task,
    sft_rows,
    shape_records,
    split_train_eval,
    task_of,
    teacher_prompt,
    union_shards,
)
from thinkframe.operators.encode import (  # noqa: F401
    assign_batches,
    batch_sample,
    byte_ids,
    encode_examples,
    ensure_eos,
    pad_batches,
    supervised_ratio,
)
from thinkframe.operators.evals import accuracy, evaluate, evaluate_keys, k_sweep, k_sweep_keys  # noqa: F401
from thinkframe.operators.ordering import first_n, nth_smallest_hash, seeded_hash  # noqa: F401
from thinkframe.operators.reports import (  # noqa: F401
    agreement_traps,
    answer_thrash,
    bench_report,
    length_by_step,
    length_histogram,
    length_summary,
    summary_of_counts,
    teacher_yield,
    think_block_rates,
)
from thinkframe.operators.rewards import attach_prompts, group_advantage, score  # noqa: F401
from thinkframe.operators.vote import (  # noqa: F401
    distribution_table,
    majority_vote,
    sample_keys,
    vote,
    vote_keys,
    weighted_vote,
)
