"""Distil filter and SFT dataset build (E1), RL prompt table.

Plan shape at scale: read -> explode samples -> cheap length predicates,
then one regex pass for the answer and the correctness rules (all narrow,
in the scan stage) -> dedupe exchange on the sha1 key (first-per-key is a
row_number = 1 filter that Spark turns into a map-side group limit) ->
per-task cap on narrow columns -> project chat rows -> split by a seeded
hash threshold (no global sort, no single-task row_number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.functions.text import (
    IM_END,
    dedupe_key,
    evaluate_once,
    extract_answer,
    has_min_words,
    pystrip,
    rl_gold,
    with_is_correct,
)
from thinkframe.operators.ordering import nth_smallest_hash, seeded_hash
from thinkframe.session import written

# --------------------------------------------------------------------------
# Prompt texts of the pipeline (must match for equal prompts).
# --------------------------------------------------------------------------
COT_INSTRUCTION = (
    "Solve the problem step by step. Show your reasoning inside <think>...</think> "
    "tags, then write the final answer on a new line prefixed with 'Answer: '."
)
SYS_PROMPT = (
    "You are a careful reasoner. Solve the problem step by step inside "
    "<think>...</think> tags, then output the final answer on a new line "
    "as 'Answer: <value>'."
)
ARC_INSTRUCTION = "\nRespond with the letter of the correct choice."
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

DEFAULT_MAX_TRACE_CHARS = 6000
DEFAULT_MIN_TRACE_TOKENS = 16


# --------------------------------------------------------------------------
# Record shaping (S8, G1, G2) and prompts
# --------------------------------------------------------------------------
def explode_records(records: DataFrame, traces: str = "traces") -> DataFrame:
    """G1: one row per trace of a teacher record, ``pos`` = list position.

    Records split into parts (``first_pos``) get their global position back.
    """
    others = [c for c in records.columns if c not in (traces, "part", "first_pos")]
    out = records.select(*others, *[c for c in ("first_pos",) if c in records.columns],
                         F.posexplode(traces).alias("pos", "trace"))
    if "first_pos" in records.columns:
        out = out.withColumn("pos", (F.col("pos") + F.col("first_pos")).cast("int")).drop("first_pos")
    return out


def shape_records(
    samples: DataFrame,
    id_col: str | None = "id",
    question: str = "question",
    gold: str = "gold",
    meta: Column | None = None,
    max_traces: int | None = None,
) -> DataFrame:
    """Flat (prompt row, pos, text) samples -> teacher records.

    ``id`` is kept when given, else sha2 of the question (repeatable, unlike a
    per-process hash). ``traces`` is ordered by ``pos``; gold and meta are
    those of the sample with the smallest ``pos`` that has them. K is the
    sampling parameter, so a record is bounded; to store an unbounded number
    of samples per prompt keep the flat rows, or give ``max_traces``: records
    then hold that many and carry ``part`` and ``first_pos``, which
    ``explode_records`` undoes.
    """
    # the bare column: samples already dealt by it are grouped where they lie
    rid = F.col(id_col) if id_col else F.sha2(F.col(question), 256)
    keys = [rid.alias("id"), F.col(question).alias("question")]
    if max_traces:
        keys.append(F.floor(F.col("pos") / max_traces).cast("int").alias("part"))

    def earliest(c: Column) -> Column:
        return F.min_by(c, F.when(c.isNotNull(), F.col("pos")))

    grouped = samples.groupBy(*keys).agg(
        earliest(F.col(gold).cast("string")).alias("gold"),
        F.sort_array(F.collect_list(F.struct(F.col("pos"), F.col("trace")))).alias("_s"),
        *([earliest(meta).alias("meta")] if meta is not None else []),
    )
    out = grouped.withColumn("id", F.col("id").cast("string")).withColumn("traces", F.transform("_s", lambda s: s["trace"])).drop("_s")
    return out.withColumn("first_pos", F.col("part") * max_traces) if max_traces else out


def join_outputs(prompts: DataFrame, outputs: DataFrame, meta: Column | None = None, on: str = "id") -> DataFrame:
    """J1 + S8: prompt rows (id, question, gold, ...) joined to the sampled
    outputs (id, pos, trace) and shaped as teacher records.

    Prompts without outputs give no record, outputs without a prompt are left
    out. ``meta`` is an expression over the joined rows. A partition's prompts,
    each of them once, are looked up by its outputs, which are not sorted.
    """
    return shape_records(outputs.select(on, "pos", "trace").join(prompts.hint("shuffle_hash"), on), on, meta=meta)


def teacher_prompt(question) -> Column:
    """Instruction, the problem, and an open think block."""
    q = F.col(question) if isinstance(question, str) else question
    return F.concat(F.lit(COT_INSTRUCTION + "\n\nProblem:\n"), q, F.lit("\n\n<think>\n"))


def chat_prompt(question) -> Column:
    """System + user turns, assistant turn left open."""
    q = F.col(question) if isinstance(question, str) else question
    return F.concat(
        F.lit(f"<|im_start|>system\n{SYS_PROMPT}{IM_END}\n<|im_start|>user\n"),
        q,
        F.lit(f"{IM_END}\n<|im_start|>assistant\n"),
    )


def arc_question(question, choices="choices") -> Column:
    """Stem, one ``{label}) {text}`` line per choice (zip stops at the shorter), instruction."""
    q = F.col(question) if isinstance(question, str) else question
    ch = F.col(choices) if isinstance(choices, str) else choices
    n = F.least(F.size(ch["label"]), F.size(ch["text"]))
    pairs = F.slice(F.arrays_zip(ch["label"].alias("l"), ch["text"].alias("t")), 1, n)
    lines = F.transform(pairs, lambda p: F.concat(p["l"], F.lit(") "), p["t"], F.lit("\n")))
    return F.concat(q, F.lit("\n\n"), F.array_join(lines, ""), F.lit(ARC_INSTRUCTION))


def repair_response(trace, answer) -> Column:
    """Make sure the response has a think block, an answer line and the end marker."""
    t = pystrip(F.col(trace) if isinstance(trace, str) else trace)
    a = F.col(answer) if isinstance(answer, str) else answer
    t = F.when(t.contains(THINK_OPEN), t).otherwise(F.concat(F.lit(THINK_OPEN + "\n"), t))
    t = F.when(t.contains(THINK_CLOSE), t).otherwise(F.concat(t, F.lit("\n" + THINK_CLOSE)))
    after_close = F.substring(t, F.instr(t, THINK_CLOSE) + len(THINK_CLOSE), 1 << 30)
    has_answer = t.contains("\nAnswer:") | after_close.contains("Answer:")
    t = F.when(has_answer, t).otherwise(F.concat(t, F.lit("\nAnswer: "), a))
    return F.concat(t, F.lit(IM_END))


def merge_task(meta, task) -> Column:
    """P5: ``meta | {"task": task}`` on a string map (right side wins)."""
    m = F.col(meta) if isinstance(meta, str) else meta
    t = F.col(task) if isinstance(task, str) else task
    base = F.coalesce(m, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: k != "task"), F.create_map(F.lit("task"), t))


# --------------------------------------------------------------------------
# Filter (F1-F3, P5, P6) and keep rate (A1)
# --------------------------------------------------------------------------
def flag_traces(
    traces: DataFrame,
    max_trace_chars: int = DEFAULT_MAX_TRACE_CHARS,
    min_trace_tokens: int = DEFAULT_MIN_TRACE_TOKENS,
    symbolic: bool = False,
) -> DataFrame:
    """Every trace with its extracted ``answer`` and a boolean ``kept`` (the filter's verdict)."""
    length_ok = F.length("trace") <= max_trace_chars
    words_ok = has_min_words(F.col("trace"), min_trace_tokens)
    flagged = evaluate_once(traces, _len_ok=length_ok & words_ok)
    flagged = evaluate_once(flagged, answer=F.when(F.col("_len_ok"), extract_answer("trace")))
    flagged = with_is_correct(flagged, "answer", "gold", "task", "_correct", symbolic)
    return evaluate_once(flagged, kept=F.col("_len_ok") & F.col("_correct")).drop("_len_ok", "_correct")


def filter_traces(
    traces: DataFrame,
    max_trace_chars: int = DEFAULT_MAX_TRACE_CHARS,
    min_trace_tokens: int = DEFAULT_MIN_TRACE_TOKENS,
    keep_cols: Sequence[str] = (),
    symbolic: bool = False,
) -> DataFrame:
    """Keep traces within length limits whose extracted answer is correct
    (``symbolic``: math answers also by value, see ``with_is_correct``).

    Input: one row per trace with id, question, gold, trace, task (and meta).
    Output: id, question, gold, trace (stripped), answer (raw extracted),
    meta with ``task`` merged in, plus ``keep_cols`` (ordinals).
    Cheap predicates are evaluated first; the regex runs only on survivors.
    """
    t = traces.where(F.length("trace") <= max_trace_chars).where(
        has_min_words(F.col("trace"), min_trace_tokens)
    )
    t = evaluate_once(t, answer=extract_answer("trace"))
    t = with_is_correct(t, "answer", "gold", "task", "_correct", symbolic)
    t = evaluate_once(t, _keep=F.col("_correct")).where("_keep")
    return kept_rows(t, keep_cols, has_meta="meta" in traces.columns)


def kept_rows(flagged: DataFrame, keep_cols: Sequence[str] = (), has_meta: bool | None = None) -> DataFrame:
    """Output shape of the filter (stripped trace, raw answer, meta with task).

    ``flagged`` is either already filtered or carries ``kept`` from
    ``flag_traces`` (then only kept rows are returned).
    """
    if "kept" in flagged.columns:
        flagged = flagged.where("kept")
    if has_meta is None:
        has_meta = "meta" in flagged.columns
    meta = F.col("meta") if has_meta else F.lit(None).cast("map<string,string>")
    return flagged.select(
        *keep_cols,
        "id",
        "question",
        "gold",
        pystrip(F.col("trace")).alias("trace"),
        "answer",
        merge_task(meta, F.col("task")).alias("meta"),
    )


def keep_rate(
    traces: DataFrame,
    max_trace_chars: int = DEFAULT_MAX_TRACE_CHARS,
    min_trace_tokens: int = DEFAULT_MIN_TRACE_TOKENS,
    by: Sequence[str] = ("task",),
) -> DataFrame:
    """A1: seen, kept and percent kept (``100 * kept / max(seen, 1)``) per group."""
    f = flag_traces(traces, max_trace_chars, min_trace_tokens)
    out = f.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("kept")).alias("kept"),
    )
    return out.withColumn("pct", F.col("kept") * 100.0 / F.greatest(F.col("seen"), F.lit(1)))


# --------------------------------------------------------------------------
# Dataset build
# --------------------------------------------------------------------------
def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Concatenate shards in the given order; ``shard_no`` keeps that order."""
    out = None
    for i, s in enumerate(shards):
        s = s.withColumn("shard_no", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def task_of(meta="meta") -> Column:
    """The record's task, ``generic`` when meta lacks it."""
    m = F.col(meta) if isinstance(meta, str) else meta
    return F.coalesce(F.element_at(m, F.lit("task")), F.lit("generic"))


def dedupe_first(df: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """Keep the first row per key in source order.

    The order is found on (key, order) alone, by a partial aggregate that
    collapses a hot key where it is read; the wide rows are touched once, by a
    semi-join on both, which sorts neither side. ``order_cols`` must tell rows of a key apart.
    """
    firsts = df.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order_cols)).alias("_o")).hint("shuffle_hash")
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.struct(*order_cols).eqNullSafe(F.col("_o")))
    return df.join(firsts, same, "left_semi")


def nth_in_order(df: DataFrame, group: str, order_cols: Sequence[str], n: int) -> DataFrame:
    """(group, limit): the order struct of each group's ``n``-th row, for groups
    with more than ``n`` rows.

    Never ranks a whole group in one task: a range exchange cuts the rows into
    ordered ranges, they are counted per (group, range), and only the range
    that holds the n-th row is ranked.
    """
    narrow = df.select(F.col(group).alias("_g"), F.struct(*order_cols).alias("_o"))
    ranged = narrow.repartitionByRange("_g", "_o").withColumn("_p", F.spark_partition_id())
    ranged = written(ranged, "cap-ranges")
    counts = ranged.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.withColumn("_upto", upto).where((F.col("_upto") >= n) & (F.col("_upto") - F.col("_n") < n))
    inside = ranged.join(hit.select("_g", "_p", (F.lit(n) - F.col("_upto") + F.col("_n")).alias("_need")), ["_g", "_p"])
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_o"))
    return inside.withColumn("_r", rank).where("_r = _need").select(F.col("_g").alias(group), F.col("_o").alias("limit"))


def cap_per_group(df: DataFrame, group: str, order_cols: Sequence[str], cap: int | None) -> DataFrame:
    """First ``cap`` rows per group in source order; ``None``/0 = no cap.

    Groups are few and large (tasks). The order of each group's ``cap``-th row
    is found on narrow rows (``nth_in_order``), and the wide rows are filtered
    once against that small table. ``order_cols`` must tell rows of a group
    apart; a null group is a group.
    """
    if not cap:
        return df
    limits = nth_in_order(df, group, order_cols, cap).select(F.col(group).alias("_g"), "limit")
    out = df.join(limits, F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.where(F.col("limit").isNull() | (F.struct(*order_cols) <= F.col("limit"))).drop("_g", "limit")


def _keyed(filtered: DataFrame) -> DataFrame:
    return filtered.withColumn("key", dedupe_key(F.col("question"), F.col("trace"))).withColumn("task", task_of("meta"))


def _first_keys(rows: DataFrame, order_cols: Sequence[str], per_task_cap: int | None, home: str | None = None) -> DataFrame:
    """(key, order columns, task, home) of the rows that dedupe and cap leave, written:
    duplicates and ranks are settled on a narrow table."""
    firsts = rows.groupBy("key").agg(F.min(F.struct(*order_cols, "task", *([home] if home else []))).alias("_o")).select("key", "_o.*")
    kept = written(firsts, "first-keys")
    return written(cap_per_group(kept, "task", order_cols, per_task_cap), "capped-keys") if per_task_cap else kept


def _survivors(rows: DataFrame, kept: DataFrame, order_cols: Sequence[str], home: str | None, parts: int | None) -> DataFrame:
    """The wide rows that ``kept`` has by key and order columns."""
    if home is None:
        kept = kept.select(F.col("key").alias("_k"), F.struct(*order_cols).alias("_o"))
        return rows.join(kept, F.col("key").eqNullSafe(F.col("_k")) & F.struct(*order_cols).eqNullSafe(F.col("_o")), "left_semi")
    kept = kept.select(F.col(home).alias("_home"), F.struct("key", *order_cols).alias("_o")).repartition(parts, "_home")
    kept = kept.groupBy("_home").agg(F.collect_set("_o").alias("_kept")).hint("shuffle_hash")
    here = F.exists("_kept", lambda o: o.eqNullSafe(F.struct("key", *order_cols)))
    return rows.join(kept, (F.col(home) == F.col("_home")) & here, "left_semi")


def _rendered(rows: DataFrame, kept: DataFrame, order_cols: Sequence[str], home: str | None = None, parts: int | None = None) -> DataFrame:
    """The wide rows of the survivors, read once more, as chat rows."""
    return _survivors(rows, kept, order_cols, home, parts).select(
        "key",
        *order_cols,
        chat_prompt("question").alias("prompt"),
        repair_response("trace", "answer").alias("response"),
        "task",
        "meta",
        *([home] if home else []),
    )


def sft_rows(
    filtered: DataFrame,
    order_cols: Sequence[str] = ("shard_no", "id", "pos"),
    per_task_cap: int | None = None,
    home: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Dedupe, cap and render filtered traces as chat rows.

    Output: key, prompt, response, task, meta, and the order columns.
    Q4: dedupe is global and precedes the cap (the sequential original lets
    a capped row's duplicate in under another task; equal otherwise).

    ``home``: a column without nulls by which the rows are already dealt to
    ``parts`` partitions, the same for rows that agree in key and order columns.
    Then the survivors' keys are sent to their rows, and no wide row is moved or
    sorted. Without it both sides are dealt by the key.
    """
    rows = _keyed(filtered)
    return _rendered(rows, _first_keys(rows, order_cols, per_task_cap, home), order_cols, home, parts)


def rows_by_task(rows: DataFrame) -> DataFrame:
    """A2: rows per task."""
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("rows"))


def _split_at(rows: DataFrame, threshold: str | None) -> DataFrame:
    is_eval = F.lit(False) if threshold is None else F.coalesce(F.col("shuffle_pos") <= F.lit(threshold), F.lit(False))
    return rows.withColumn("split", F.when(is_eval, "eval").otherwise("train"))


def _threshold(hashes: DataFrame, eval_frac: float, with_eval: bool) -> str | None:
    """The largest hash of the eval split (None: no eval rows) of a written table of hashes."""
    if not with_eval or eval_frac <= 0:
        return None
    return nth_smallest_hash(hashes, "shuffle_pos", lambda rows: int(rows * eval_frac))


def split_keys(keys: DataFrame, key: str = "key", seed: int = 17, eval_frac: float = 0.02, with_eval: bool = True) -> DataFrame:
    """``split_train_eval`` of a narrow table: it is computed and hashed once,
    written with its hashes, and split from there."""
    hashed = written(keys.withColumn("shuffle_pos", seeded_hash(seed, F.col(key))), "hashed-keys")
    return _split_at(hashed, _threshold(hashed, eval_frac, with_eval))


def split_train_eval(
    rows: DataFrame,
    key: str = "key",
    seed: int = 17,
    eval_frac: float = 0.02,
    with_eval: bool = True,
) -> DataFrame:
    """L2 + L3: seeded shuffle position and an exact-size eval split.

    ``n_eval = int(n * eval_frac)`` rows with the smallest seeded hash go to
    eval (0 without an eval output), the rest to train. ``shuffle_pos`` (hex
    md5) orders rows repeatably. Only the hashes are written and counted (one
    narrow column); the rows themselves are filtered against the threshold.
    """
    rows = rows.withColumn("shuffle_pos", seeded_hash(seed, F.col(key)))
    hashes = written(rows.select("shuffle_pos"), "split-hashes") if with_eval and eval_frac > 0 else rows
    return _split_at(rows, _threshold(hashes, eval_frac, with_eval))


def build_dataset(
    filtered: DataFrame,
    order_cols: Sequence[str] = ("shard_no", "id", "pos"),
    per_task_cap: int | None = None,
    eval_frac: float = 0.02,
    seed: int = 17,
    with_eval: bool = True,
    home: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """E1 build step: SFT rows with ``split`` and ``shuffle_pos``.

    Dedupe, cap and split are settled on the keys, so the filtered rows are
    read twice in all: for their keys, and once more to be rendered.
    ``home`` and ``parts``: see ``sft_rows``.
    """
    rows = _keyed(filtered)
    kept = _first_keys(rows, order_cols, per_task_cap, home)
    hashes = kept.select(seeded_hash(seed, F.col("key")).alias("shuffle_pos"))
    threshold = _threshold(hashes, eval_frac, with_eval)
    return _split_at(_rendered(rows, kept, order_cols, home, parts).withColumn("shuffle_pos", seeded_hash(seed, F.col("key"))), threshold)


def rl_prompts(train: DataFrame, order_col: str = "shuffle_pos", exact_suffix: bool = False) -> DataFrame:
    """W3 + X16: one RL prompt per distinct prompt (first in train order), gold recovered.

    Rows are written without their responses; prompts are told apart by their
    sha2, and the first ones are looked up by the rows, which are not sorted.
    """
    meta_gold = (
        F.element_at(F.col("meta"), F.lit("gold")) if "meta" in train.columns else F.lit(None).cast("string")
    )
    t = train.select(
        "prompt",
        order_col,
        rl_gold(meta_gold, F.col("response"), exact_suffix).alias("gold"),
        F.coalesce(F.col("task"), F.lit("generic")).alias("task"),
        F.sha2("prompt", 256).alias("_key"),
    )
    return dedupe_first(written(t, "rl-candidates"), "_key", [order_col]).select("prompt", "gold", "task", order_col)
