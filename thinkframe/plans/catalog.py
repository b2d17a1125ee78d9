"""Registered queries: one per operator group, over the driver's tables.

Queries read ``documents`` (through the trace fixture, see
``sources/fixture.py``) or ``conversations``, so their work grows with the
tables; none caps rows
except where the limit is the operator (per-task cap, sampled batch).
Computed columns carry explicit names shared with the DuckDB twins in
``plans/oracle_queries.py``; doubles are rounded to 9 places for comparison.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinkframe.functions import symbolic as S
from thinkframe.functions import text as T
from thinkframe.operators import distill as D
from thinkframe.operators import encode as E
from thinkframe.operators import evals as V
from thinkframe.operators import reports as P
from thinkframe.operators import rewards as RW
from thinkframe.operators.vote import DEFAULT_STRATEGY, distribution_table, leader_changes, sample_keys, vote
from thinkframe.operators.ordering import exact_quantiles, first_n
from thinkframe.session import shared_path, written
from thinkframe.sources import bucketed, io
from thinkframe.sources import fixture as X

# Parameters of the registered queries (fixed values shared with the SQL twins).
CAP = 150
SEED = 17
EVAL_FRAC = 0.02
SAMPLE_K = 32
COMPRESSION = "gzip"  # of the record files


def _r9(c):
    return F.round(c, 9)


def _traces(spark, sf, k=X.K_SAMPLES, by=None):
    return X.traces(spark, sf, k, by)


def _with_answer(spark, sf):
    return T.evaluate_once(_traces(spark, sf), answer=T.extract_answer("trace"))


# ---------------------------------------------------------------- phase 1
def q_extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _traces(spark, sf).select("id", "pos", T.extract_answer("trace").alias("answer"))


def q_norm_letter(spark, sf):
    return _with_answer(spark, sf).select("id", "pos", T.norm_letter("answer").alias("letter"))


def q_norm_math(spark, sf):
    return _with_answer(spark, sf).select("id", "pos", T.norm_math("answer").alias("norm"))


def q_vote_key(spark, sf):
    return T.with_vote_key(_with_answer(spark, sf), "answer", "task", "key").select("id", "pos", "key")


def q_majority_vote(spark, sf):
    v = vote(_traces(spark, sf), strategy="majority")
    return v.select("id", "task", "answer", "support", "total", _r9("confidence").alias("confidence"))


def q_vote_distribution(spark, sf):
    return distribution_table(sample_keys(_traces(spark, sf)))


# ---------------------------------------------------------------- phase 2
def q_is_correct(spark, sf):
    t = T.with_is_correct(_with_answer(spark, sf), "answer", "gold", "task", "correct")
    return t.select("id", "pos", "correct")


def _expressions(spark, sf):
    return T.evaluate_once(X.expression_traces(spark, sf), answer=T.extract_answer("trace"))


def _counted(df, *cols):
    """Each combination of ``cols`` once, with its number of rows ``n``: what depends
    on these columns alone is worked out once for each, in as many tasks as the session has."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).repartition(tasks, *cols)


def q_symbolic_equal(spark, sf):
    """X8 by value on the answer of every expression trace (NULL: undecided)."""
    t = written(_expressions(spark, sf).select("id", "pos", "form", "answer", "gold"), "expression-answers")
    pairs = S.with_symbolic_equal(_counted(t, "answer", "gold"), "answer", "gold", "equal")
    pairs = pairs.select(F.col("answer").alias("_a"), F.col("gold").alias("_g"), "equal")
    t = t.join(pairs, F.col("answer").eqNullSafe(F.col("_a")) & F.col("gold").eqNullSafe(F.col("_g")))
    return t.select("id", "pos", "form", "answer", "equal")


def q_symbolic_correct(spark, sf):
    """X7 with equality by value: what each form keeps by form and by value."""
    t = _counted(_expressions(spark, sf), "form", "answer", "gold", "task")
    t = T.with_is_correct(t, "answer", "gold", "task", "by_form")
    t = T.with_is_correct(t, "answer", "gold", "task", "by_value", symbolic=True)
    kept = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("by_form", "by_value")]
    return t.groupBy("form").agg(F.sum("n").alias("seen"), *kept)


def q_canonical_answers(spark, sf):
    """Answers grouped by value: how many spellings and samples each value has."""
    t = S.with_canonical(_counted(_expressions(spark, sf), "form", "answer"), "answer", "_value")
    t = T.evaluate_once(t, value=F.col("_value"))  # the filter below stays above the counts
    per_value = t.where("value IS NOT NULL").groupBy("form", "value").agg(F.count("answer").alias("spellings"), F.sum("n").alias("n"))
    return per_value.groupBy("form").agg(F.count(F.lit(1)).alias("n_values"), F.sum("spellings").alias("spellings"), F.sum("n").alias("samples"), F.max("n").alias("most"))


def _filtered(spark, sf, by=None):
    return D.filter_traces(X.with_meta(_traces(spark, sf, by=by)), keep_cols=["pos", *([by] if by else [])])


def q_distill_filter(spark, sf):
    f = _filtered(spark, sf)
    return f.select(
        "id", "pos", "trace", "answer",
        F.element_at("meta", F.lit("task")).alias("meta_task"),
        F.element_at("meta", F.lit("teacher")).alias("meta_teacher"),
    )


def q_keep_rate(spark, sf):
    k = D.keep_rate(_traces(spark, sf))
    return k.select("task", "seen", "kept", _r9("pct").alias("pct"))


def q_gold_gsm8k(spark, sf):
    docs = X.documents(spark, sf)
    return docs.select(
        F.col("doc_id").alias("id"),
        T.gold_gsm8k(F.col("text")).alias("gold_text"),
        T.gold_gsm8k(F.concat(F.lit("so #### "), (F.col("doc_id") % 97 + 3).cast("string"))).alias("gold_item"),
    )


def _records(spark, sf):
    return D.shape_records(X.with_meta(_traces(spark, sf, by="rid")), "rid", meta=F.col("meta"))


def _record_digest(rec):
    return rec.select(
        "id", "gold", F.size("traces").alias("n_traces"), F.md5(F.array_join("traces", "\x01")).alias("traces_md5"),
        F.element_at("meta", F.lit("teacher")).alias("teacher"), F.element_at("meta", F.lit("gold")).alias("meta_gold"),
    )


def q_teacher_records(spark, sf):
    return _record_digest(_records(spark, sf))


def q_join_outputs(spark, sf):
    """Prompt rows joined to their sampled outputs, shaped as records."""
    t = X.with_meta(_traces(spark, sf, by="id"))
    prompts = X.with_meta(X.prompts(spark, sf, by="id")).drop("task", "lang", "source")
    return _record_digest(D.join_outputs(prompts, t.select("id", "pos", "trace"), meta=F.col("meta")))


def q_explode_records(spark, sf):
    """G1: records back to one row per trace."""
    flat = D.explode_records(_records(spark, sf))
    return flat.select("id", "pos", F.md5("trace").alias("trace_md5"), F.element_at("meta", F.lit("teacher")).alias("teacher"))


# ---------------------------------------------------------------- sources and sinks
def _task_shards(spark, sf):
    rec = D.shape_records(X.with_meta(_traces(spark, sf, by="rid")), "rid", meta=F.struct("meta", "task"))
    rec = written(rec.select("id", "question", "gold", "traces", F.col("meta.meta").alias("meta"), F.col("meta.task").alias("task")), "records")
    return [rec.where(F.col("task") == task).drop("task") for task in ("arc", "gsm8k", "math", "generic")]


def _traces_digest(rec, *extra):
    return rec.select("id", F.size("traces").alias("n_traces"), F.md5(F.array_join("traces", "\x01")).alias("traces_md5"), *extra)


def q_jsonl_round_trip(spark, sf):
    """S1 + S3: records written as JSON Lines and read back."""
    path = shared_path(spark, "records-jsonl")
    io.write_jsonl(_records(spark, sf), path, order_by=["id"], columns=["id", "question", "gold", "traces", "meta"], compression=COMPRESSION)
    return _traces_digest(io.read_jsonl(spark, path, io.TEACHER_RECORD))


def q_jsonl_line_numbers(spark, sf):
    """S1 with true line numbers: records written in id order, read with their
    place among all lines, whatever the files and splits."""
    path = shared_path(spark, "numbered-jsonl")
    io.write_jsonl(_records(spark, sf), path, order_by=["id"], columns=["id", "question", "gold", "traces", "meta"], compression=COMPRESSION)
    return io.read_numbered_jsonl(spark, path, io.TEACHER_RECORD).select("id", F.col("src_ordinal").alias("line"))


def q_jsonl_shards(spark, sf):
    """One JSON Lines shard per task, read in the given order."""
    paths = []
    for i, shard in enumerate(_task_shards(spark, sf)):
        paths.append(shared_path(spark, f"shard-{i}"))
        io.write_jsonl(shard, paths[-1], compression=COMPRESSION)
    return _traces_digest(io.read_shards(spark, paths, io.TEACHER_RECORD), "shard_no")


def q_union_shards(spark, sf):
    """Shard tables concatenated, their order kept."""
    t = _traces(spark, sf).select("id", "pos", "task")
    return D.union_shards([t.where(F.col("task") == x) for x in ("arc", "gsm8k", "math", "generic")]).select("id", "pos", "shard_no")


def q_first_rows(spark, sf):
    """L1: the first rows in source order."""
    return first_n(_traces(spark, sf).select("id", "pos"), ["id", "pos"], CAP)


def q_prompt_table(spark, sf):
    """A prompt file whose prompt field has another name."""
    path = shared_path(spark, "prompts-jsonl")
    io.write_jsonl(X.prompts(spark, sf), path, columns=["id", "question", "task"])
    return io.read_prompts(spark, path, "question", schema="id long, question string, task string").select("id", "prompt", "task")


def q_train_eval_files(spark, sf):
    """Train and eval files written, and read with the optional eval."""
    split = written(_split(spark, sf).select("prompt", "response", "task", "split", "shuffle_pos"), "split-rows")
    paths = {x: shared_path(spark, f"{x}-jsonl") for x in ("train", "eval")}
    for x, path in paths.items():
        io.write_jsonl(split.where(F.col("split") == x), path, order_by=["shuffle_pos"], columns=["prompt", "response", "task"], compression=COMPRESSION)
    train, ev = io.read_train_eval(spark, paths["train"], paths["eval"])
    cols = ["prompt", "response", "task"]
    return train.select(*cols, F.lit("train").alias("split")).union(ev.select(*cols, F.lit("eval").alias("split")))


def q_eval_files(spark, sf):
    """S6 + S7: results written per benchmark and model (its tag holds a dot), and read back."""
    rows = written(_eval_rows(spark, sf), "eval-rows")
    root = shared_path(spark, "runs")
    for bench, _ in V.BENCHES:
        io.write_eval(rows.where(F.col("bench") == bench), f"{root}/{bench}.v1.5-{bench}")
    found = io.read_eval_results(spark, root)
    n = rows.groupBy("bench").agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, "bench").select("bench", "model", _r9("acc").alias("acc"), "n")


# ---------------------------------------------------------------- phase 3
def q_dedupe_key(spark, sf):
    return _traces(spark, sf).select("id", "pos", T.dedupe_key(F.col("question"), F.col("trace")).alias("key"))


def q_dedupe_first(spark, sf):
    t = _traces(spark, sf).withColumn("key", T.dedupe_key(F.col("question"), F.col("trace")))
    return D.dedupe_first(t, "key", ["id", "pos"]).select("key", "id", "pos")


def q_bucketed_first(spark, sf):
    """W1 over a table bucketed by the key: no exchange where it is read."""
    t = _traces(spark, sf).withColumn("key", T.dedupe_key(F.col("question"), F.col("trace"))).select("key", "id", "pos", "trace")
    keyed = bucketed.write_bucketed(t, f"traces_{uuid.uuid4().hex}", ["key"], ["id", "pos"], buckets=X.dealt_parts(spark, sf))
    return bucketed.first_per_key(keyed, ["key"], ["id", "pos"]).select("key", "id", "pos")


def _sft(spark, sf, cap=None):
    return D.sft_rows(_filtered(spark, sf, "home"), order_cols=["id", "pos"], per_task_cap=cap, home="home", parts=X.dealt_parts(spark, sf))


def q_per_task_cap(spark, sf):
    return _sft(spark, sf, CAP).select("key", "task", "id", "pos")


def q_rows_by_task(spark, sf):
    return D.rows_by_task(_sft(spark, sf))


def q_sft_rows(spark, sf):
    return _sft(spark, sf).select("key", "prompt", "response", "task")


def _split(spark, sf):
    return D.build_dataset(_filtered(spark, sf, "home"), ["id", "pos"], None, EVAL_FRAC, SEED, home="home", parts=X.dealt_parts(spark, sf))


def q_train_eval_split(spark, sf):
    f = _filtered(spark, sf).select("id", "pos", T.dedupe_key(F.col("question"), F.col("trace")).alias("key"))
    keys = f.groupBy("key").agg(F.min(F.struct("id", "pos")).alias("first")).select("key")
    return D.split_keys(keys, "key", SEED, EVAL_FRAC).select("key", "split")


def q_rl_prompts(spark, sf):
    train = _split(spark, sf).where(F.col("split") == "train")
    return D.rl_prompts(train).select("prompt", "gold", "task")


def q_teacher_prompts(spark, sf):
    return X.prompts(spark, sf).select("id", D.teacher_prompt("question").alias("prompt"))


# ---------------------------------------------------------------- phase 4
def _completions(spark, sf):
    c = X.with_messages(_traces(spark, sf)).select(
        F.col("id").alias("prompt_id"), "pos", "messages"
    )
    p = X.prompts(spark, sf).select(F.col("id").alias("prompt_id"), "gold", "task")
    return RW.attach_prompts(c, p, "prompt_id")


def _scored(spark, sf, specs):
    return RW.score(_completions(spark, sf), specs, text=None, messages="messages")


def q_reward_correctness(spark, sf):
    s = _scored(spark, sf, [("correctness", 1.0, {})])
    return s.select("prompt_id", "pos", F.col("reward"))


def q_reward_answer_present(spark, sf):
    s = _scored(spark, sf, [("answer_present", 1.0, {})])
    return s.select("prompt_id", "pos", _r9("reward").alias("reward"))


def q_reward_format(spark, sf):
    s = _scored(spark, sf, [("format", 1.0, {})])
    return s.select("prompt_id", "pos", _r9("reward").alias("reward"))


def q_reward_length(spark, sf):
    s = _scored(spark, sf, [("length_penalty", 1.0, {})])
    return s.select("prompt_id", "pos", _r9("reward").alias("reward"))


def q_bucketed_rewards(spark, sf):
    """J2 + R5 over completions and prompts bucketed by prompt: a join without an exchange."""
    c = X.with_messages(_traces(spark, sf)).select(F.col("id").alias("prompt_id"), "pos", "messages")
    p = X.prompts(spark, sf).select(F.col("id").alias("prompt_id"), "gold", "task")
    name, buckets = uuid.uuid4().hex, X.dealt_parts(spark, sf)
    c = bucketed.write_bucketed(c, f"completions_{name}", ["prompt_id"], ["pos"], buckets=buckets)
    p = bucketed.write_bucketed(p, f"prompts_{name}", ["prompt_id"], buckets=buckets)
    s = RW.score(RW.attach_prompts(c, p), RW.R.DEFAULT_MIX, text=None, messages="messages")
    return s.select("prompt_id", "pos", _r9("reward").alias("reward"))


def _letter_share(text, letter="e"):
    return text.str.count(letter) / text.str.len().clip(lower=1)


def q_registered_reward(spark, sf):
    """U-1: a reward of the user's beside the native ones in one mix."""
    if own := "letter_share" not in RW.R.REGISTRY:
        RW.R.register("letter_share", _letter_share, reads=["text"], parameters=["letter"])
    s = _scored(spark, sf, [*RW.R.DEFAULT_MIX, {"name": "letter_share", "weight": 0.5, "kwargs": {"letter": "e"}}])
    if own:  # the plan has it; the registry is left as it was
        RW.R.unregister("letter_share")
    return s.select("prompt_id", "pos", _r9("r_letter_share").alias("r_letter_share"), _r9("reward").alias("reward"))


def q_reward_mix(spark, sf):
    s = _scored(spark, sf, RW.R.DEFAULT_MIX)
    return s.select(
        "prompt_id", "pos",
        *[_r9(f"r_{n}").alias(f"r_{n}") for n, _, _ in RW.R.DEFAULT_MIX],
        _r9("reward").alias("reward"),
    )


def q_group_advantage(spark, sf):
    s = _scored(spark, sf, RW.R.DEFAULT_MIX)
    a = RW.group_advantage(s, "prompt_id", columns=["pos"])
    return a.select("prompt_id", "pos", _r9("reward").alias("reward"), _r9("advantage").alias("advantage"))


# ---------------------------------------------------------------- phase 5
def q_arc_questions(spark, sf):
    it = X.arc_items(spark, sf, every=True)
    return it.select("id", D.arc_question("question", "choices").alias("question"))


_WEIGHT = T.logprob_weight


def _eval_rows(spark, sf, extra=()):
    t = X.with_logprobs(_traces(spark, sf))
    return V.evaluate(t, X.bench_items(spark, sf), DEFAULT_STRATEGY, weight=_WEIGHT("logprob_sum", "n_tokens"), extra=extra)


def q_eval_items(spark, sf):
    r = _eval_rows(spark, sf)
    return r.select("bench", "id", "gold", "pred", "support", "k", _r9("confidence").alias("confidence"), "correct")


def q_accuracy(spark, sf):
    a = V.accuracy(_eval_rows(spark, sf))
    return a.select("bench", "n", "n_correct", _r9("acc").alias("acc"))


def q_weighted_vote(spark, sf):
    t = X.with_logprobs(_traces(spark, sf))
    v = vote(t, strategy="weighted", weight=T.logprob_weight("logprob_sum", "n_tokens"))
    return v.select("id", "answer", "support", "total")


def q_k_sweep(spark, sf):
    k = V.k_sweep(_traces(spark, sf, 16), X.bench_items(spark, sf))
    return k.select("k", *[_r9(b).alias(b) for b, _ in V.BENCHES])


def q_k_sweep_table(spark, sf):
    """A10 + J3 with the Ks as a table: every K from 1 to 40 over 16 samples, by weight."""
    ks = spark.range(1, 41).select(F.col("id").alias("k"))
    t = X.with_logprobs(_traces(spark, sf, 16))
    k = V.k_sweep(t, X.bench_items(spark, sf), ks, DEFAULT_STRATEGY, _WEIGHT("logprob_sum", "n_tokens"))
    return k.select("k", *[_r9(b).alias(b) for b, _ in V.BENCHES])


def q_leader_changes(spark, sf):
    """The winner of the vote so far, wherever it changes (16 samples per item)."""
    return leader_changes(sample_keys(_traces(spark, sf, 16)), last=16 - 1).select("id", "pos", "answer")


def q_bench_report(spark, sf):
    rows = _eval_rows(spark, sf, extra=("source",))
    acc = V.accuracy(rows, ("bench", "source")).select("bench", F.col("source").alias("model"), "acc")
    return P.bench_report(spark, acc)


def q_length_summary(spark, sf):
    s = P.length_summary(_traces(spark, sf), stage="lang")
    return s.select("stage", "count", *[_r9(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def q_group_quantiles(spark, sf):
    """A11's selection on a column with nearly as many values as rows: seven quantiles
    of a per-sample score, per source."""
    t = _traces(spark, sf).select("source", (F.length("trace") * 1000 + (F.col("id") * 37 + F.col("pos") * 11) % 1000).alias("x"))
    counts = written(t.groupBy("source", "x").agg(F.count(F.lit(1)).alias("n")), "score-counts")
    probs = (0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0)
    q = exact_quantiles(counts, ["source"], "x", probs)
    return q.select("source", *[F.round(f"q{i}", 3).alias(f"q{i}") for i in range(len(probs))])


def q_length_histogram(spark, sf):
    h = P.length_histogram(_traces(spark, sf), stage="lang")
    return h.select("stage", "bin", _r9("bin_lo").alias("bin_lo"), _r9("bin_hi").alias("bin_hi"), "count", "has_mark")


# ---------------------------------------------------------------- phase 6
def _encoded(spark, sf):
    return E.encode_examples(_sft(spark, sf))


def _ids_md5(c):
    return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


def q_encode_examples(spark, sf):
    e = _encoded(spark, sf)
    return e.select(
        "key",
        F.size("input_ids").alias("n_ids"),
        F.size(F.filter("labels", lambda x: x != E.IGNORE_INDEX)).alias("n_supervised"),
        _ids_md5("input_ids").alias("ids_md5"),
        _ids_md5("labels").alias("labels_md5"),
    )


def _padded(spark, sf):
    rows = E.assign_batches(_sft(spark, sf), "key", E.encoded_length(), batch_size=4, seed=SEED, home="home", parts=X.dealt_parts(spark, sf))
    return E.pad_batches(E.encode_examples(rows))


def q_pad_batches(spark, sf):
    p = _padded(spark, sf)
    return p.select(
        "key", "bucket", "batch_no",
        F.size("input_ids").alias("width"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
        F.element_at("labels", -1).alias("last_label"),
        _ids_md5("input_ids").alias("ids_md5"),
    )


def q_supervised_ratio(spark, sf):
    r = E.supervised_ratio(_padded(spark, sf))
    return r.select("supervised", "cells", _r9("ratio").alias("ratio"))


def q_batch_sample(spark, sf):
    return E.batch_sample(_sft(spark, sf), "key", SAMPLE_K, SEED).select("key", "task")


# ---------------------------------------------------------------- phase 7
def q_agreement_traps(spark, sf):
    d = P.agreement_traps(_eval_rows(spark, sf))
    return d.select("bench", "items", "traps", _r9("trap_rate").alias("trap_rate"))


def q_answer_thrash(spark, sf):
    d = P.answer_thrash(_traces(spark, sf))
    return d.select("task", "traces", "multi_answer", _r9("multi_rate").alias("multi_rate"))


def q_teacher_yield(spark, sf):
    flagged = D.flag_traces(_traces(spark, sf), D.DEFAULT_MAX_TRACE_CHARS, D.DEFAULT_MIN_TRACE_TOKENS)
    d = P.teacher_yield(flagged.withColumnRenamed("source", "teacher"))
    return d.select("teacher", "traces", "correct", _r9("correct_rate").alias("correct_rate"))


def q_usable_per_hour(spark, sf):
    """D3: usable traces per hour, from a throughput table per teacher."""
    flagged = D.flag_traces(_traces(spark, sf)).withColumnRenamed("source", "teacher")
    teachers = X.documents(spark, sf).select(F.col("source").alias("teacher")).distinct()
    rate = F.when(F.col("teacher") == "src0", 1350).otherwise(100 + F.length("teacher") * 10).cast("double")
    d = P.teacher_yield(flagged, traces_per_hour=teachers.select("teacher", rate.alias("traces_per_hour")))
    return d.select("teacher", "traces_per_hour", _r9("usable_per_hour").alias("usable_per_hour"))


def q_conversation_rewards(spark, sf):
    """P8, R2-R4 on the real assistant messages of ``conversations``, by name (U-1)."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where(F.col("role") == "assistant")
    messages = F.array(F.struct(F.col("role"), F.col("text").alias("content")))
    named = [{"name": n} for n in ("format", "length_penalty", "answer_present")]
    scored = RW.score(turns.select("conv_id", "turn", messages.alias("messages")), named, text=None, messages="messages")
    return scored.select("conv_id", "turn", *[_r9(f"r_{x['name']}").alias(f"r_{x['name']}") for x in named])


def q_think_block_rates(spark, sf):
    d = P.think_block_rates(_traces(spark, sf))
    return d.select(
        "task", "traces", "missing_block", "empty_block",
        _r9("missing_rate").alias("missing_rate"), _r9("empty_rate").alias("empty_rate"),
    )


def q_length_by_step(spark, sf):
    t = _traces(spark, sf).withColumn("step", (F.col("id") % 10).cast("int"))
    d = P.length_by_step(t)
    return d.select("step", "completions", _r9("mean_tokens").alias("mean_tokens"))


QUERIES = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
