"""DuckDB SQL for each registered query (verification twins of ``catalog``).

Written independently of the Spark code path, from the same rules, so a
mismatch points at a semantic difference. Doubles are rounded to 9 places
as on the Spark side.
"""

from __future__ import annotations

from thinkframe import oracle as O
from thinkframe.operators.distill import ARC_INSTRUCTION, COT_INSTRUCTION, SYS_PROMPT
from thinkframe.plans.catalog import CAP, EVAL_FRAC, SAMPLE_K, SEED
from thinkframe.operators.evals import BENCHES

q = O.q
S = O.strip
NL = "chr(10)"

TRACES = f"traces AS ({O.traces_sql()})"
TRACES16 = f"traces AS ({O.traces_sql(16)})"
WA = f"wa AS (SELECT *, {O.extract('trace')} AS answer FROM traces)"
BASE = f"base AS ({O.DOCS_SQL})"


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r9(x: str) -> str:
    return f"round({x}, 9)"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ---------------------------------------------------------------- votes
def vote_ctes(keys_src: str, ids: list[str], weighted: bool | str = False, name: str = "votes") -> list[str]:
    """keys_src must expose ids, task, pos, key (and w when weighted)."""
    idl = ", ".join(ids)
    # the fixture's weights are whole multiples of 2^-60: their sum is exact, then rounded
    score = "CAST(sum(CAST(w * 1152921504606846976 AS HUGEINT)) AS DOUBLE) / 1152921504606846976" if weighted else "CAST(count(*) AS DOUBLE)"
    if weighted == "by task":
        score = f"CASE WHEN any_value(task) IN ('gsm8k', 'math') THEN {score} ELSE CAST(count(*) AS DOUBLE) END"
    return [
        f"""{name}_pk AS (SELECT {idl}, task, key, count(*) AS cnt, min(pos) AS first_pos, {score} AS score
  FROM {keys_src} GROUP BY ALL)""",
        f"""{name} AS (SELECT {idl}, task, CAST(sum(cnt) AS BIGINT) AS total,
  arg_max(key, (score, -first_pos)) FILTER (WHERE key IS NOT NULL) AS answer,
  coalesce(arg_max(cnt, (score, -first_pos)) FILTER (WHERE key IS NOT NULL), 0) AS support,
  coalesce(string_agg(key || ':' || cnt, ',' ORDER BY key || ':' || cnt) FILTER (WHERE key IS NOT NULL), '') AS distribution
  FROM {name}_pk GROUP BY ALL)""",
    ]


WEIGHT = "CASE WHEN pos * 3 <= 0 THEN 1.0::DOUBLE ELSE exp(((pos + 1) * (1 + id % 7) * -0.37::DOUBLE) / (pos * 3)) END"
KEYS = f"keys AS (SELECT id, task, pos, {O.vote_key('answer', 'task')} AS key, {WEIGHT} AS w FROM wa)"


def conf(total="total", support="support"):
    return f"CASE WHEN {total} > 0 THEN CAST({support} AS DOUBLE) / {total} ELSE 0.0 END"


# ---------------------------------------------------------------- filter / build
FLAG = f"""flag AS (SELECT *, length(trace) <= 6000 AND {O.word_count('trace')} >= 16 AS len_ok FROM traces)"""
FLAG_A = f"flag_a AS (SELECT *, CASE WHEN len_ok THEN {O.extract('trace')} END AS answer FROM flag)"
FLAG_K = f"flag_k AS (SELECT *, len_ok AND {O.is_correct('answer', 'gold', 'task')} AS kept FROM flag_a)"
FILTERED = f"""filtered AS (SELECT id, pos, question, gold, {S('trace')} AS trace, answer, task, source,
  CASE WHEN id % 5 = 0 THEN 'meta ' || gold END AS meta_gold FROM flag_k WHERE kept)"""
KEYED = f"keyed AS (SELECT *, {O.dedupe_key('question', 'trace')} AS key FROM filtered)"
FIRST = "firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY id, pos) = 1)"

_PROMPT_HEAD = f"<|im_start|>system\n{SYS_PROMPT}<|im_end|>\n<|im_start|>user\n"
_PROMPT_TAIL = "<|im_end|>\n<|im_start|>assistant\n"


def _sqlstr(s: str) -> str:
    """A Python string as SQL, newlines via chr(10)."""
    parts = s.split("\n")
    return f" || {NL} || ".join(q(p) for p in parts)


SFT = [
    f"r0 AS (SELECT key, id, pos, task, meta_gold, question, answer, {S('trace')} AS t0 FROM firsts)",
    f"r1 AS (SELECT *, CASE WHEN contains(t0, '<think>') THEN t0 ELSE '<think>' || {NL} || t0 END AS t1 FROM r0)",
    f"r2 AS (SELECT *, CASE WHEN contains(t1, '</think>') THEN t1 ELSE t1 || {NL} || '</think>' END AS t2 FROM r1)",
    f"""r3 AS (SELECT *, CASE WHEN contains(t2, {NL} || 'Answer:') OR contains(substring(t2, instr(t2, '</think>') + 8), 'Answer:')
        THEN t2 ELSE t2 || {NL} || 'Answer: ' || answer END AS t3 FROM r2)""",
    f"""sft AS (SELECT key, id, pos, task, meta_gold, {_sqlstr(_PROMPT_HEAD)} || question || {_sqlstr(_PROMPT_TAIL)} AS prompt,
        t3 || '<|im_end|>' AS response FROM r3)""",
]

SPLIT = f"""split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || key))
   <= CAST(floor((count(*) OVER ()) * {dbl(EVAL_FRAC)}) AS BIGINT) THEN 'eval' ELSE 'train' END AS split,
   md5('{SEED}:' || key) AS shuffle_pos FROM sft)"""

FILTER_CHAIN = [TRACES, FLAG, FLAG_A, FLAG_K, FILTERED, KEYED, FIRST]


# ---------------------------------------------------------------- rewards
COMP = f"comp AS (SELECT t.id AS prompt_id, t.pos, t.trace AS text, p.gold, p.task FROM traces t JOIN (SELECT DISTINCT id, gold, task FROM traces) p ON t.id = p.id)"
COMP_A = f"comp_a AS (SELECT *, {O.extract('text')} AS pred FROM comp)"
R_CORRECT = f"CASE WHEN {O.is_correct('pred', 'gold', 'task')} THEN {dbl(1.0)} ELSE {dbl(0.0)} END"
R_PRESENT = f"CASE WHEN {O.has_answer_line('text')} THEN {dbl(0.1)} ELSE {dbl(0.0)} END"


def _format_ctes() -> list[str]:
    return [
        """fm0 AS (SELECT *, contains(text, '<think>') AS has_open, contains(text, '</think>') AS has_close,
      split_part(text, '</think>', 1) AS head, substring(text, instr(text, '</think>') + 8) AS tail FROM comp_a)""",
        f"""fm AS (SELECT *,
      {dbl(0.0)} + (CASE WHEN has_open AND has_close THEN {dbl(0.15)} WHEN has_close AND NOT has_open THEN {dbl(-0.05)} ELSE {dbl(0.0)} END)
      + (CASE WHEN {O.has_answer_line('text')} THEN {dbl(0.1)} ELSE {dbl(0.0)} END)
      + (CASE WHEN has_close AND {O.has_answer_line('head')} THEN {dbl(-0.1)} ELSE {dbl(0.0)} END)
      + (CASE WHEN has_close AND NOT {O.has_answer_line('tail')} THEN {dbl(-0.05)} ELSE {dbl(0.0)} END) AS r_format
      FROM fm0)""",
    ]


R_LENGTH = (
    "CASE WHEN greatest(1, length(text) // 4) <= 512 THEN 0.0::DOUBLE "
    "WHEN greatest(1, length(text) // 4) >= 1024 THEN -0.5::DOUBLE "
    "ELSE -0.5::DOUBLE * (CAST(greatest(1, length(text) // 4) - 512 AS DOUBLE) / 512) END"
)

MIX = [COMP, COMP_A] + _format_ctes() + [
    f"""mix0 AS (SELECT prompt_id, pos, {R_CORRECT} AS r_correctness, r_format, {R_LENGTH} AS r_length_penalty,
      {R_PRESENT} AS r_answer_present FROM fm)""",
    f"""mix AS (SELECT *, {dbl(1.0)} * r_correctness + {dbl(0.2)} * r_format + {dbl(0.1)} * r_length_penalty
      + {dbl(0.05)} * r_answer_present AS reward FROM mix0)""",
]


# ---------------------------------------------------------------- eval
ITEMS_ARC = f"items_arc AS (SELECT doc_id AS id, upper({S('g')}) AS gold, source FROM base WHERE task = 'arc')"
ITEMS_GSM = f"items_gsm AS (SELECT doc_id AS id, {O.gold_gsm8k(chr(39) + 'so #### ' + chr(39) + ' || g')} AS gold, source FROM base WHERE task = 'gsm8k')"
ITEMS_MATH = f"items_math AS (SELECT doc_id AS id, {S('g')} AS gold, source FROM base WHERE task = 'math')"


def eval_ctes(votes: str = "votes", ids: tuple[str, ...] = ("id",), items_k: str = "") -> list[str]:
    """Eval rows for the three benches from a votes CTE keyed by ``ids``."""
    on = " AND ".join(f"i.{c} = v.{c}" for c in ids)
    sel = ", ".join(f"i.{c}" for c in ids)
    kx = items_k

    def it(name):
        return f"(SELECT * FROM {name}{kx})" if kx else name

    gpf = O.py_float(O.norm_math("v.answer"))
    ggf = O.py_float(O.norm_math("i.gold"))
    gsm_ok = (
        f"CASE WHEN v.answer IS NULL THEN false ELSE coalesce(CASE WHEN {gpf} IS NOT NULL AND {ggf} IS NOT NULL "
        f"THEN {O.float_equal(gpf, ggf)} ELSE {S('v.answer')} = {S('i.gold')} END, false) END"
    )
    return [
        f"""ev AS (
  SELECT 'arc_c' AS bench, {sel}, i.source, i.gold, v.answer AS pred, coalesce(v.support, 0) AS support, coalesce(v.total, 0) AS k,
    coalesce({conf('v.total', 'v.support')}, 0.0) AS confidence,
    upper({S("coalesce(v.answer, '')")}) = i.gold AS correct
  FROM {it('items_arc')} i LEFT JOIN {votes} v ON {on}
  UNION ALL
  SELECT 'gsm8k', {sel}, i.source, i.gold, v.answer, coalesce(v.support, 0), coalesce(v.total, 0),
    coalesce({conf('v.total', 'v.support')}, 0.0), {gsm_ok}
  FROM {it('items_gsm')} i LEFT JOIN {votes} v ON {on}
  UNION ALL
  SELECT 'math_500', {sel}, i.source, i.gold, v.answer, coalesce(v.support, 0), coalesce(v.total, 0),
    coalesce({conf('v.total', 'v.support')}, 0.0),
    CASE WHEN v.answer IS NULL THEN false ELSE {O.math_equal('v.answer', 'i.gold')} END
  FROM {it('items_math')} i LEFT JOIN {votes} v ON {on})"""
    ]


EVAL = [TRACES, WA, KEYS, *vote_ctes("keys", ["id"], weighted="by task"), BASE, ITEMS_ARC, ITEMS_GSM, ITEMS_MATH, *eval_ctes()]


# ---------------------------------------------------------------- encode
def byte_ids(s: str) -> str:
    return f"list_transform(regexp_extract_all(hex({s}), '..'), lambda x: CAST(('0x' || x) AS INTEGER) + 2)"


ENC = [
    *FILTER_CHAIN,
    *SFT,
    f"enc0 AS (SELECT key, task, {byte_ids('prompt')} AS p, {byte_ids('response || chr(1)')} AS r FROM sft)",
    "enc1 AS (SELECT *, list_slice(list_concat(p, r), 1, 2048) AS ids FROM enc0)",
    """enc AS (SELECT *, list_concat(list_transform(range(least(len(p), len(ids))), lambda i: -100),
        list_slice(ids, least(len(p), len(ids)) + 1, len(ids))) AS labels FROM enc1)""",
]
BATCH = [
    f"""bat0 AS (SELECT *, CAST(('0x' || substring(md5('{SEED}:' || key), 1, 8)) AS BIGINT) % ((count(*) OVER () + 16383) // 16384) AS bucket,
        md5('{SEED}:' || key) AS h FROM enc)""",
    "bat1 AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY h) - 1) // 4 AS batch_no FROM bat0)",
    "bat AS (SELECT *, max(len(ids)) OVER (PARTITION BY bucket, batch_no) AS width FROM bat1)",
    """padded AS (SELECT key, bucket, batch_no, width, len(ids) AS mask_sum,
        list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0)) AS pids,
        list_concat(labels, list_transform(range(width - len(ids)), lambda i: -100)) AS plabels FROM bat)""",
]


def ids_md5(x: str) -> str:
    return f"md5(array_to_string({x}, ','))"


# ---------------------------------------------------------------- the table
def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["extract_answer"] = w(TRACES) + f"SELECT id, pos, {O.extract('trace')} AS answer FROM traces"
    sql["norm_letter"] = w(TRACES, WA) + f"SELECT id, pos, {O.norm_letter('answer')} AS letter FROM wa"
    sql["norm_math"] = w(TRACES, WA) + f"SELECT id, pos, {O.norm_math('answer')} AS norm FROM wa"
    sql["vote_key"] = w(TRACES, WA) + f"SELECT id, pos, {O.vote_key('answer', 'task')} AS key FROM wa"
    sql["majority_vote"] = w(TRACES, WA, KEYS, *vote_ctes("keys", ["id"])) + (
        f"SELECT id, task, answer, support, total, {r9(conf())} AS confidence FROM votes"
    )
    sql["vote_distribution"] = w(TRACES, WA, KEYS) + (
        "SELECT id, key, count(*) AS count FROM keys WHERE key IS NOT NULL GROUP BY id, key"
    )
    sql["is_correct"] = w(TRACES, WA) + f"SELECT id, pos, {O.is_correct('answer', 'gold', 'task')} AS correct FROM wa"
    sql["distill_filter"] = w(TRACES, FLAG, FLAG_A, FLAG_K, FILTERED) + (
        "SELECT id, pos, trace, answer, task AS meta_task, source AS meta_teacher FROM filtered"
    )
    sql["keep_rate"] = w(TRACES, FLAG, FLAG_A, FLAG_K) + (
        "SELECT task, count(*) AS seen, count(*) FILTER (WHERE kept) AS kept, "
        f"{r9('(count(*) FILTER (WHERE kept)) * 100.0::DOUBLE / greatest(count(*), 1)')} AS pct FROM flag_k GROUP BY task"
    )
    sql["gold_gsm8k"] = (
        f"SELECT doc_id AS id, {O.gold_gsm8k('text')} AS gold_text, "
        f"{O.gold_gsm8k(chr(39) + 'so #### ' + chr(39) + ' || CAST(doc_id % 97 + 3 AS VARCHAR)')} AS gold_item FROM documents"
    )
    sql["teacher_records"] = w(TRACES) + (
        "SELECT CAST(id AS VARCHAR) AS id, any_value(gold) AS gold, CAST(count(*) AS INTEGER) AS n_traces, "
        "md5(string_agg(trace, chr(1) ORDER BY pos)) AS traces_md5, "
        "any_value(source) AS teacher, any_value(CASE WHEN id % 5 = 0 THEN 'meta ' || gold END) AS meta_gold FROM traces GROUP BY id, question"
    )
    sql["join_outputs"] = sql["teacher_records"]
    sql["explode_records"] = w(TRACES) + "SELECT CAST(id AS VARCHAR) AS id, pos, md5(trace) AS trace_md5, source AS teacher FROM traces"
    sql["jsonl_line_numbers"] = w(BASE) + "SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS line FROM base"
    for name in ("jsonl_round_trip", "jsonl_shards"):
        extra = ", CAST(CASE task WHEN 'arc' THEN 0 WHEN 'gsm8k' THEN 1 WHEN 'math' THEN 2 ELSE 3 END AS INTEGER) AS shard_no" if name == "jsonl_shards" else ""
        sql[name] = w(TRACES) + (
            "SELECT CAST(id AS VARCHAR) AS id, CAST(count(*) AS INTEGER) AS n_traces, md5(string_agg(trace, chr(1) ORDER BY pos)) AS traces_md5"
            f"{extra} FROM traces GROUP BY id, question, task"
        )
    sql["prompt_table"] = w(BASE) + "SELECT doc_id AS id, text AS prompt, task FROM base"
    sql["train_eval_files"] = w(*FILTER_CHAIN, *SFT, SPLIT) + "SELECT prompt, response, task, split FROM split"
    sql["union_shards"] = w(TRACES) + (
        "SELECT id, pos, CAST(CASE task WHEN 'arc' THEN 0 WHEN 'gsm8k' THEN 1 WHEN 'math' THEN 2 ELSE 3 END AS INTEGER) AS shard_no FROM traces"
    )
    sql["first_rows"] = w(TRACES) + f"SELECT id, pos FROM traces ORDER BY id, pos LIMIT {CAP}"
    sql["dedupe_key"] = w(TRACES) + f"SELECT id, pos, {O.dedupe_key('question', 'trace')} AS key FROM traces"
    sql["dedupe_first"] = w(TRACES) + (
        f"SELECT key, id, pos FROM (SELECT id, pos, {O.dedupe_key('question', 'trace')} AS key FROM traces) "
        "QUALIFY row_number() OVER (PARTITION BY key ORDER BY id, pos) = 1"
    )
    sql["bucketed_first"] = sql["dedupe_first"]
    sql["per_task_cap"] = w(*FILTER_CHAIN) + (
        f"SELECT key, task, id, pos FROM firsts QUALIFY row_number() OVER (PARTITION BY task ORDER BY id, pos) <= {CAP}"
    )
    sql["rows_by_task"] = w(*FILTER_CHAIN) + "SELECT task, count(*) AS rows FROM firsts GROUP BY task"
    sql["sft_rows"] = w(*FILTER_CHAIN, *SFT) + "SELECT key, prompt, response, task FROM sft"
    sql["train_eval_split"] = w(*FILTER_CHAIN, *SFT, SPLIT) + "SELECT key, split FROM split"
    rl_tail = S("split_part(response, 'Answer:', -1)")
    sql["rl_prompts"] = w(*FILTER_CHAIN, *SFT, SPLIT) + (
        f"SELECT prompt, coalesce(meta_gold, {S(f'rtrim({rl_tail}, {q(chr(60) + chr(124) + 'im_end' + chr(124) + chr(62))})')}) AS gold, "
        "coalesce(task, 'generic') AS task FROM split WHERE split = 'train' "
        "QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY shuffle_pos) = 1"
    )
    sql["teacher_prompts"] = w(BASE) + (
        f"SELECT doc_id AS id, {_sqlstr(COT_INSTRUCTION + chr(10) + chr(10) + 'Problem:' + chr(10))} || question || "
        f"{_sqlstr(chr(10) + chr(10) + '<think>' + chr(10))} AS prompt FROM base"
    )
    sql["reward_correctness"] = w(TRACES, COMP, COMP_A) + f"SELECT prompt_id, pos, {R_CORRECT} AS reward FROM comp_a"
    sql["reward_answer_present"] = w(TRACES, COMP) + f"SELECT prompt_id, pos, {r9(R_PRESENT)} AS reward FROM comp"
    sql["reward_format"] = w(TRACES, COMP, COMP_A, *_format_ctes()) + f"SELECT prompt_id, pos, {r9('r_format')} AS reward FROM fm"
    sql["reward_length"] = w(TRACES, COMP) + f"SELECT prompt_id, pos, {r9(R_LENGTH)} AS reward FROM comp"
    sql["reward_mix"] = w(TRACES, *MIX) + (
        "SELECT prompt_id, pos, "
        + ", ".join(f"{r9(c)} AS {c}" for c in ("r_correctness", "r_format", "r_length_penalty", "r_answer_present", "reward"))
        + " FROM mix"
    )
    sql["bucketed_rewards"] = w(TRACES, *MIX) + f"SELECT prompt_id, pos, {r9('reward')} AS reward FROM mix"
    share = "CAST(length(said) - length(replace(said, 'e', '')) AS DOUBLE) / greatest(length(said), 1)"
    sql["registered_reward"] = w(TRACES, *MIX) + f"SELECT prompt_id, pos, {r9(share)} AS r_letter_share, {r9(f'reward + 0.5::DOUBLE * ({share})')} AS reward FROM mix JOIN (SELECT prompt_id, pos, text AS said FROM comp) USING (prompt_id, pos)"
    sql["group_advantage"] = w(TRACES, *MIX) + (
        f"SELECT prompt_id, pos, {r9('reward')} AS reward, "
        f"{r9('(reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-6::DOUBLE)')} AS advantage "
        "FROM mix WINDOW g AS (PARTITION BY prompt_id)"
    )
    fifth = "CAST(ceil(length(text) / 5) AS INTEGER)"
    choice_lines = " || ".join(
        f"'{c}) ' || substring(text, {fifth} * {i} + 1, {fifth}) || {NL}" for i, c in enumerate("ABCDE")
    )
    sql["arc_questions"] = w(BASE) + (
        f"SELECT doc_id AS id, question || {NL} || {NL} || {choice_lines} || {_sqlstr(ARC_INSTRUCTION)} AS question "
        "FROM base"
    )
    sql["eval_items"] = w(*EVAL) + (
        f"SELECT bench, id, gold, pred, support, k, {r9('confidence')} AS confidence, correct FROM ev"
    )
    acc = "CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / greatest(count(*), 1)"
    sql["accuracy"] = w(*EVAL) + (
        f"SELECT bench, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct, {r9(acc)} AS acc FROM ev GROUP BY bench"
    )
    sql["weighted_vote"] = w(TRACES, WA, KEYS, *vote_ctes("keys", ["id"], weighted=True)) + (
        "SELECT id, answer, support, total FROM votes"
    )
    ks = "(SELECT unnest([1, 2, 4, 8, 16]) AS sweep_k)"
    kkeys = f"kkeys AS (SELECT k.sweep_k, id, task, pos, {O.vote_key('answer', 'task')} AS key FROM wa JOIN {ks} k ON wa.pos < k.sweep_k)"
    k_ev = eval_ctes("kvotes", ("sweep_k", "id"), items_k=f" CROSS JOIN {ks}")
    sql["k_sweep"] = w(TRACES16, WA, kkeys, *vote_ctes("kkeys", ["sweep_k", "id"], name="kvotes"), BASE,
                       ITEMS_ARC, ITEMS_GSM, ITEMS_MATH, *k_ev,
                       f"kacc AS (SELECT bench, sweep_k, CASE WHEN max(k) >= sweep_k THEN {acc} END AS acc FROM ev GROUP BY bench, sweep_k)") + (
        "SELECT sweep_k AS k, "
        + ", ".join(f"{r9(f'max(acc) FILTER (WHERE bench = {q(b)})')} AS {b}" for b, _ in BENCHES)
        + " FROM kacc GROUP BY sweep_k"
    )
    many = "(SELECT unnest(range(1, 41)) AS sweep_k)"
    wkeys = f"kkeys AS (SELECT k.sweep_k, id, task, pos, {O.vote_key('answer', 'task')} AS key, {WEIGHT} AS w FROM wa JOIN {many} k ON wa.pos < k.sweep_k)"
    sql["k_sweep_table"] = w(TRACES16, WA, wkeys, *vote_ctes("kkeys", ["sweep_k", "id"], weighted="by task", name="kvotes"), BASE,
                             ITEMS_ARC, ITEMS_GSM, ITEMS_MATH, *eval_ctes("kvotes", ("sweep_k", "id"), items_k=f" CROSS JOIN {many}"),
                             f"kacc AS (SELECT bench, sweep_k, CASE WHEN max(k) >= sweep_k THEN {acc} END AS acc FROM ev GROUP BY bench, sweep_k)") + (
        "SELECT CAST(sweep_k AS INTEGER) AS k, "
        + ", ".join(f"{r9(f'max(acc) FILTER (WHERE bench = {q(b)})')} AS {b}" for b, _ in BENCHES)
        + " FROM kacc GROUP BY sweep_k"
    )
    each = "(SELECT unnest(range(1, 17)) AS sweep_k)"
    ekeys = f"kkeys AS (SELECT k.sweep_k, id, task, pos, {O.vote_key('answer', 'task')} AS key FROM wa JOIN {each} k ON wa.pos < k.sweep_k)"
    sql["leader_changes"] = w(TRACES16, WA, ekeys, *vote_ctes("kkeys", ["sweep_k", "id"], name="kvotes"),
                              "prior AS (SELECT *, lag(answer) OVER (PARTITION BY id ORDER BY sweep_k) AS old FROM kvotes)") + (
        "SELECT id, CAST(sweep_k - 1 AS INTEGER) AS pos, answer FROM prior WHERE answer IS DISTINCT FROM old"
    )
    benches = ", ".join(f"({i}, {q(b)}, {q(n)})" for i, (b, n) in enumerate(BENCHES))
    report = w(
        *EVAL,
        f"macc AS (SELECT bench, source AS model, {acc} AS acc FROM ev GROUP BY ALL)",
        "models AS (SELECT DISTINCT model FROM macc)",
        f"grid AS (SELECT * FROM (VALUES {benches}) b(bench_no, bench, bench_name), models)",
        "cells AS (SELECT g.*, CASE WHEN a.acc IS NULL THEN 'n/a' ELSE printf('%.3f', a.acc) END AS cell "
        "FROM grid g LEFT JOIN macc a ON g.bench = a.bench AND g.model = a.model)",
    )
    sql["bench_report"] = report + (
        f"SELECT 0 AS line_no, {_sqlstr('# Reasoning post-training results' + chr(10))} AS line "
        "UNION ALL SELECT 1, '| bench | ' || string_agg(model, ' | ' ORDER BY model) || ' |' FROM models "
        "UNION ALL SELECT 2, repeat('|---', 1 + count(*)::INTEGER) || '|' FROM models "
        "UNION ALL SELECT bench_no + 3, '| ' || bench_name || ' | ' || string_agg(cell, ' | ' ORDER BY model) || ' |' "
        "FROM cells GROUP BY bench_no, bench_name"
    )
    sql["eval_files"] = w(*EVAL) + f"SELECT bench, 'v1.5-' || bench AS model, {r9(acc)} AS acc, count(*) AS n FROM ev GROUP BY bench"
    tok = "(length(trace) // 4)"
    sql["length_summary"] = w(TRACES) + (
        f"SELECT lang AS stage, count(*) AS count, {r9(f'avg({tok})')} AS mean, {r9(f'stddev_samp({tok})')} AS std, "
        f"{r9(f'CAST(min({tok}) AS DOUBLE)')} AS min, "
        + ", ".join(f"{r9(f'quantile_cont({tok}, {p})')} AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
        + f", {r9(f'CAST(max({tok}) AS DOUBLE)')} AS max FROM traces GROUP BY lang"
    )
    sql["group_quantiles"] = w(TRACES) + (
        "SELECT source, " + ", ".join(f"round(quantile_cont(CAST(length(trace) * 1000 + (id * 37 + pos * 11) % 1000 AS DOUBLE), {p}), 3) AS q{i}"
                                      for i, p in enumerate((0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0))) + " FROM traces GROUP BY source"
    )
    sql["length_histogram"] = w(
        TRACES,
        f"hx AS (SELECT lang AS stage, CAST({tok} AS BIGINT) AS x FROM traces)",
        "rng AS (SELECT stage, min(x) AS lo, max(x) AS hi FROM hx GROUP BY stage)",
        """hb AS (SELECT h.stage, CASE WHEN r.hi = r.lo THEN 21 ELSE least(40, (40 * (h.x - r.lo)) // (r.hi - r.lo) + 1) END AS bin
            FROM hx h JOIN rng r ON h.stage = r.stage)""",
        "hc AS (SELECT stage, bin, count(*) AS cnt FROM hb GROUP BY ALL)",
        """ab AS (SELECT r.stage, r.lo, r.hi, b.bin FROM rng r, (SELECT unnest(range(1, 41)) AS bin) b)""",
        """hist AS (SELECT ab.stage, ab.bin,
            CASE WHEN hi = lo THEN lo - 0.5::DOUBLE ELSE CAST(lo AS DOUBLE) END
              + (ab.bin - 1) * (CASE WHEN hi = lo THEN 1.0::DOUBLE / 40 ELSE CAST(hi - lo AS DOUBLE) / 40.0::DOUBLE END) AS bin_lo,
            CASE WHEN hi = lo THEN lo - 0.5::DOUBLE ELSE CAST(lo AS DOUBLE) END
              + ab.bin * (CASE WHEN hi = lo THEN 1.0::DOUBLE / 40 ELSE CAST(hi - lo AS DOUBLE) / 40.0::DOUBLE END) AS bin_hi,
            coalesce(hc.cnt, 0) AS count FROM ab LEFT JOIN hc ON ab.stage = hc.stage AND ab.bin = hc.bin)""",
    ) + (
        f"SELECT stage, CAST(bin AS INTEGER) AS bin, {r9('bin_lo')} AS bin_lo, {r9('bin_hi')} AS bin_hi, count, "
        "(bin_lo <= 512 AND 512 < bin_hi) OR (bin_lo <= 1024 AND 1024 < bin_hi) AS has_mark FROM hist"
    )
    sql["encode_examples"] = w(*ENC) + (
        f"SELECT key, CAST(len(ids) AS INTEGER) AS n_ids, CAST(len(list_filter(labels, lambda x: x <> -100)) AS INTEGER) AS n_supervised, "
        f"{ids_md5('ids')} AS ids_md5, {ids_md5('labels')} AS labels_md5 FROM enc"
    )
    sql["pad_batches"] = w(*ENC, *BATCH) + (
        f"SELECT key, CAST(bucket AS INTEGER) AS bucket, CAST(batch_no AS INTEGER) AS batch_no, CAST(width AS INTEGER) AS width, CAST(mask_sum AS INTEGER) AS mask_sum, "
        f"plabels[-1] AS last_label, {ids_md5('pids')} AS ids_md5 FROM padded"
    )
    sql["supervised_ratio"] = w(*ENC, *BATCH) + (
        "SELECT CAST(sum(len(list_filter(plabels, lambda x: x <> -100))) AS BIGINT) AS supervised, CAST(sum(len(plabels)) AS BIGINT) AS cells, "
        f"{r9('CAST(sum(len(list_filter(plabels, lambda x: x <> -100))) AS DOUBLE) / greatest(sum(len(plabels)), 1)')} AS ratio FROM padded"
    )
    sql["batch_sample"] = w(*FILTER_CHAIN, *SFT) + f"SELECT key, task FROM sft ORDER BY md5('{SEED}:' || key) LIMIT {SAMPLE_K}"
    sql["agreement_traps"] = w(*EVAL) + (
        "SELECT bench, count(*) AS items, count(*) FILTER (WHERE support = k AND k > 0 AND NOT correct) AS traps, "
        f"{r9('CAST(count(*) FILTER (WHERE support = k AND k > 0 AND NOT correct) AS DOUBLE) / greatest(count(*), 1)')} AS trap_rate "
        "FROM ev GROUP BY bench"
    )
    marker = q(O.MARKER)
    multi = f"len(regexp_extract_all(trace, {marker})) > 1"
    sql["answer_thrash"] = w(TRACES) + (
        f"SELECT task, count(*) AS traces, count(*) FILTER (WHERE {multi}) AS multi_answer, "
        f"{r9(f'CAST(count(*) FILTER (WHERE {multi}) AS DOUBLE) / greatest(count(*), 1)')} AS multi_rate FROM traces GROUP BY task"
    )
    sql["teacher_yield"] = w(TRACES, FLAG, FLAG_A, FLAG_K) + (
        "SELECT source AS teacher, count(*) AS traces, count(*) FILTER (WHERE kept) AS correct, "
        f"{r9('CAST(count(*) FILTER (WHERE kept) AS DOUBLE) / greatest(count(*), 1)')} AS correct_rate FROM flag_k GROUP BY source"
    )
    blk = "(contains(trace, '<think>') AND contains(trace, '</think>'))"
    inner = "split_part(split_part(trace, '</think>', 1), '<think>', -1)"
    empty = f"({blk} AND length({S(inner)}) = 0)"
    sql["think_block_rates"] = w(TRACES) + (
        f"SELECT task, count(*) AS traces, count(*) FILTER (WHERE NOT {blk}) AS missing_block, "
        f"count(*) FILTER (WHERE {empty}) AS empty_block, "
        f"{r9(f'CAST(count(*) FILTER (WHERE NOT {blk}) AS DOUBLE) / greatest(count(*), 1)')} AS missing_rate, "
        f"{r9(f'CAST(count(*) FILTER (WHERE {empty}) AS DOUBLE) / greatest(count(*), 1)')} AS empty_rate "
        "FROM traces GROUP BY task"
    )
    per_hour = "CASE WHEN source = 'src0' THEN 1350 ELSE 100 + length(source) * 10 END"
    sql["usable_per_hour"] = w(TRACES, FLAG, FLAG_A, FLAG_K) + (
        f"SELECT source AS teacher, CAST({per_hour} AS DOUBLE) AS traces_per_hour, "
        f"{r9(f'CAST({per_hour} AS DOUBLE) * ((count(*) FILTER (WHERE kept))::DOUBLE / greatest(count(*), 1))')} AS usable_per_hour FROM flag_k GROUP BY source"
    )
    sql["conversation_rewards"] = (
        "WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'), "
        f"comp_a AS (SELECT * FROM m), {', '.join(_format_ctes())} "
        f"SELECT conv_id, turn, {r9('r_format')} AS r_format, {r9(R_LENGTH)} AS r_length_penalty, {r9(R_PRESENT)} AS r_answer_present FROM fm"
    )
    expr = f"expr AS ({O.expressions_sql()})"
    sql["symbolic_equal"] = w(expr) + "SELECT id, pos, form, answer, equal FROM expr"
    sql["symbolic_correct"] = w(expr, f"judged AS (SELECT form, {O.is_correct('answer', 'gold', q('math'))} AS same_form, equal FROM expr)") + (
        "SELECT form, count(*) AS seen, count(*) FILTER (WHERE same_form) AS by_form, count(*) FILTER (WHERE same_form OR equal) AS by_value FROM judged GROUP BY form"
    )
    sql["canonical_answers"] = w(expr, "per AS (SELECT form, value, count(DISTINCT answer) AS spellings, count(*) AS n FROM expr WHERE value IS NOT NULL GROUP BY ALL)") + (
        "SELECT form, count(*) AS n_values, CAST(sum(spellings) AS BIGINT) AS spellings, CAST(sum(n) AS BIGINT) AS samples, max(n) AS most FROM per GROUP BY form"
    )
    sql["length_by_step"] = w(TRACES) + (
        f"SELECT CAST(id % 10 AS INTEGER) AS step, count(*) AS completions, {r9(f'avg({tok})')} AS mean_tokens "
        "FROM traces GROUP BY ALL"
    )
    return sql
