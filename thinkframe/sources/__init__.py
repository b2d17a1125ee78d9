"""Sources and sinks (JSONL / Parquet with source order) and the driver-table fixture."""

from thinkframe.sources.bucketed import first_per_key, hot_keys, read_bucketed, write_bucketed  # noqa: F401
from thinkframe.sources.io import (  # noqa: F401
    numbered_lines,
    read_eval_results,
    read_jsonl,
    read_numbered_jsonl,
    read_prompts,
    read_shards,
    read_train_eval,
    spread,
    write_eval,
    write_jsonl,
    write_table,
)
