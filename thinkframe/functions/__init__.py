"""Column functions: text rules (X*, F*, P8) and rewards (R*)."""

from thinkframe.functions.rewards import (  # noqa: F401
    REGISTRY,
    answer_present,
    correctness,
    format_reward,
    length_penalty,
    Reward,
    Term,
)
from thinkframe.functions.text import (  # noqa: F401
    approx_tokens,
    approx_tokens_raw,
    arc_eval_equal,
    completion_text,
    dedupe_key,
    evaluate_once,
    extract_answer,
    g10,
    gold_after_hashes,
    gold_gsm8k,
    gsm8k_eval_equal,
    has_answer_line,
    has_min_words,
    logprob_weight,
    norm_letter,
    norm_math,
    py_float,
    pystrip,
    rational,
    rationals_equal,
    rl_gold,
    with_is_correct,
    with_math_equal,
    with_vote_key,
    word_count,
)
