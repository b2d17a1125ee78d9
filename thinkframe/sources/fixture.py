"""Trace fixture derived from the ``documents`` table.

The driver tables hold no answer lines, so K teacher traces per document
(K = 8; 16 for the K-sweep) are derived from ``documents`` by arithmetic on
``doc_id`` and ``k``: about 55 % carry the intended answer in one of several
surface forms, 1 in 16 has no answer line, slot 7 has two answer lines, slot 6
puts the answer before the body. A document's whole text is the question.

Tasks: one document in 20 is ``generic`` (free-text answer); the others take
turns between arc, gsm8k and math. Rules' odd branches occur too: arc golds
without a letter, long decimals whose equality needs more than 9 digits,
``1_0`` forms, metadata with and without a gold, zero lengths and really
different weights. The rows grow with ``documents``; the expansion is a narrow
``explode(sequence(0, k-1))`` (no join).

Derived companions: eval items per bench (ARC choices are the text cut in
five), chat-message completions, and per-sample log-prob sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinkframe.functions.text import evaluate_once, pystrip
from thinkframe.sources.io import spread

K_SAMPLES = 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def dealt_parts(spark: SparkSession, sf_dir: str, k: int = K_SAMPLES) -> int:
    """Partitions for rows that hold each text about 2 k times (a question and a
    trace per sample): as many per split of the table, so that a task's rows
    take about as much as a split, whatever the table's size."""
    splits = spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions()
    return max(2 * k * splits, spark.sparkContext.defaultParallelism)


def dealt_documents(spark: SparkSession, sf_dir: str, by: str, k: int = K_SAMPLES) -> DataFrame:
    """``documents`` with a column by which its rows are dealt, so that what is
    made of a document stays beside it. Texts move once, before they are
    repeated per sample; the number of partitions is ``dealt_parts``.

    * ``id``: the id itself;
    * ``rid``: the id as text, in ranges, so that the partitions are in its order;
    * ``home``: a hash of id and normalised text, which no null or repeated id makes large.
    """
    docs, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), dealt_parts(spark, sf_dir, k)
    if by == "id":
        return docs.repartition(n, "doc_id")
    if by == "rid":
        return docs.withColumn("rid", F.col("doc_id").cast("string")).repartitionByRange(n, "rid")
    return docs.withColumn("home", F.xxhash64("doc_id", F.lower(pystrip("text")))).repartition(n, "home")


def _doc_base(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    task = (
        F.when(d % 20 == 19, "generic").when(d % 3 == 0, "arc").when(d % 3 == 1, "gsm8k").otherwise("math")
    )
    g = (
        F.when(task == "generic", F.concat(F.lit("Text "), (d % 9).cast("string")))
        .when(task == "arc", F.when(d % 30 == 0, "?").otherwise(F.expr("chr(cast(65 + doc_id % 4 as int))")))
        .when(task == "gsm8k", (F.lit(3) + d % 97).cast("string"))
        .when(d % 9 == 2, F.concat(F.lit("0.12345678901"), (F.lit(1) + d % 7).cast("string")))
        .otherwise(F.concat((F.lit(1) + d % 7).cast("string"), F.lit("/"), (F.lit(2) + d % 5).cast("string")))
    )
    dealt = [c for c in ("rid", "home") if c in docs.columns]
    return docs.select("doc_id", "text", "lang", "source", F.col("text").alias("question"), task.alias("task"), g.alias("g"), *dealt)


def traces(spark: SparkSession, sf_dir: str, k: int = K_SAMPLES, by: str | None = None) -> DataFrame:
    """(id, pos, task, question, gold, trace, lang, source): one row per sample.

    ``by``: they also carry this column of ``dealt_documents`` and lie as it deals them.
    """
    base = _doc_base(dealt_documents(spark, sf_dir, by, k) if by else documents(spark, sf_dir))
    x = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    d, kk, task, g = F.col("doc_id"), F.col("k"), F.col("task"), F.col("g")
    right = (
        F.when(task == "arc",
               F.when(kk % 3 == 0, g)
               .when(kk % 3 == 1, F.concat(F.lit("("), F.lower(g), F.lit(")")))
               .otherwise(F.concat(g, F.lit(" is best"))))
        .when(task == "gsm8k",
              F.when(kk % 4 == 0, F.when(d % 11 == 0, F.regexp_replace(g, "^(.)(.)$", "$1_$2")).otherwise(g))
              .when(kk % 4 == 1, F.concat(g, F.lit(".0")))
              .when(kk % 4 == 2, F.concat(F.lit("$"), g))
              .otherwise(F.concat(g, F.lit("."))))
        .when(task == "generic", F.when(kk % 2 == 0, F.upper(g)).otherwise(F.concat(F.lit(" "), g)))
        .otherwise(F.when(kk % 2 == 0, F.when(d % 9 == 2, F.concat(g, F.lit("0"))).otherwise(g))
                   .otherwise(F.concat(F.lit("\\boxed{"), g, F.lit("}"))))
    )
    wrong = F.when(task == "arc", F.expr("chr(cast(65 + (doc_id + k + 1) % 5 as int))")).otherwise(
        ((d + kk) % 3).cast("string")
    )
    ans = F.when((d * 31 + kk * 17) % 20 < 11, right).otherwise(wrong)
    body = F.col("text")
    nl = F.lit("\n")
    trace = (
        F.when((d + kk) % 16 == 0, body)
        .when(kk == 7, F.concat(body, nl, F.lit("</think>"), nl, F.lit("Answer: "), ans, nl, F.lit("Answer: 0")))
        .when(kk == 6, F.concat(F.lit("Answer: "), ans, nl, body))
        .otherwise(F.concat(F.lit("<think>"), nl, body, nl, F.lit("</think>"), nl, F.lit("Answer: "), ans))
    )
    gold = F.when(task == "gsm8k", F.concat(F.lit("so #### "), g)).otherwise(g)
    out = x.select(
        d.alias("id"), kk.cast("int").alias("pos"), "task", "question",
        gold.alias("gold"), "lang", "source", trace.alias("_trace"), *([by] if by in base.columns else []),
    )
    # build each trace once even when later filters read it
    return evaluate_once(out, trace=F.col("_trace")).drop("_trace")


def expression_traces(spark: SparkSession, sf_dir: str, k: int = K_SAMPLES) -> DataFrame:
    """(id, pos, form, task, gold, trace): math answers that are expressions.

    Twelve forms take turns (products, fractions, roots, sets, tuples,
    intervals, matrices, powers, units), each over a = 1..7, b = 2..6,
    c = 1..9; about half of the samples say the same as gold in another form.
    The answer line follows the document's text.
    """
    x = documents(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    x = x.selectExpr(
        "doc_id", "text", "k", "(doc_id + k) % 12 as form", "(doc_id * 31 + k * 17) % 20 < 11 as same",
        "1 + doc_id % 7 as a", "2 + doc_id % 5 as b", "1 + floor(doc_id / 7) % 9 as c",
    )
    one = "if(same, 0, 1)"
    forms = {  # gold, answer
        0: (r"'(x+' || a || ')(x-' || b || ')'", rf"'x^2+(' || (a - b + {one}) || ')x-' || a * b"),
        1: (r"'\\frac{' || a || '}{' || b || '}+\\frac{1}{' || c || '}'", rf"'\\dfrac{{' || (a * c + b + {one}) || '}}{{' || b * c || '}}'"),
        2: (r"'\\sqrt{' || a * a * b || '}'", rf"(a + {one}) || '\\sqrt{{' || b || '}}'"),
        3: (r"'\\frac{' || a || '}{\\sqrt{' || b || '}}'", rf"'\\frac{{' || a || '\\sqrt{{' || b || '}}}}{{' || (b + {one}) || '}}'"),
        4: (r"'(' || a || '+\\sqrt{' || b || '})^2'", rf"(a * a + b + {one}) || '+' || 2 * a || '\\sqrt ' || b"),
        5: (r"'\\{' || a || ', ' || b || ', ' || (a + b) || '\\}'", r"if(same, '\\left\\{', '(') || (a + b) || ',' || b || ',' || a || if(same, '\\right\\}', ')')"),
        6: (r"'(' || a || ', \\frac{' || b || '}{2})'", r"if(same, '(' || a || ',' || b || '/2)', '(' || b || '/2,' || a || ')')"),
        7: (r"'[' || a || ', ' || (a + b) || ')'", r"'\\left[' || a || ',\\frac{' || 2 * (a + b) || '}{2}' || if(same, '\\right)', '\\right]')"),
        8: (r"'\\begin{pmatrix}' || a || ' & ' || b || '\\\\ ' || c || ' & 1\\end{pmatrix}'", r"'\\begin{bmatrix}' || a || '&' || if(same, b, c) || '\\\\' || if(same, 2 * c, 2 * b) || '/2&1\\end{bmatrix}'"),
        9: (r"'\\frac{' || a || '\\pi}{' || b || '}'", r"if(same, a || '/' || b || '\\cdot\\pi', '\\frac{' || b || '\\pi}{' || a || '}')"),
        10: (r"'' || a", r"a || '\\text{ units}'"),
        11: (r"'x^{' || a || '}\\cdot x^{' || b || '}'", r"'x^{' || if(same, a + b, a * b) || '}'"),
    }

    def of(i):
        return F.expr("CASE form " + " ".join(f"WHEN {n} THEN {pair[i]}" for n, pair in forms.items()) + " END")

    trace = F.concat("text", F.lit("\nAnswer: "), of(1))
    out = x.select(F.col("doc_id").alias("id"), F.col("k").cast("int").alias("pos"), F.col("form").cast("int").alias("form"), F.lit("math").alias("task"), of(0).alias("gold"), trace.alias("_trace"))
    return evaluate_once(out, trace=F.col("_trace")).drop("_trace")


def with_meta(t: DataFrame) -> DataFrame:
    """Attach the provenance map a teacher record carries; every fifth document's has a gold."""
    gold = F.when(F.col("id") % 5 == 0, F.create_map(F.lit("gold"), F.concat(F.lit("meta "), F.col("gold"))))
    none = F.create_map().cast("map<string,string>")
    return t.withColumn("meta", F.map_concat(F.create_map(F.lit("teacher"), F.col("source")), F.coalesce(gold, none)))


def with_messages(t: DataFrame) -> DataFrame:
    """Completion as a one-message chat list (the other completion shape)."""
    msg = F.struct(F.lit("assistant").alias("role"), F.col("trace").alias("content"))
    return t.withColumn("messages", F.array(msg))


def with_logprobs(t: DataFrame) -> DataFrame:
    """Per-sample log-prob sum and length for the weighted vote; sample 0 has length 0."""
    total = (F.col("pos") + 1) * (F.lit(1) + F.col("id") % 7) * F.lit(-0.37)
    return t.withColumn("logprob_sum", total).withColumn("n_tokens", F.col("pos") * 3)


def arc_items(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """ARC items of the arc documents (``every``: of all documents): the text is
    the question and, cut in five, the choices."""
    base = _doc_base(documents(spark, sf_dir))
    base = base if every else base.where(F.col("task") == "arc")
    labels = F.array(*[F.lit(c) for c in "ABCDE"])
    fifth = F.ceil(F.length("text") / 5).cast("int")
    texts = F.array(*[F.col("text").substr(fifth * i + 1, fifth) for i in range(5)])
    return base.select(
        F.col("doc_id").alias("id"), "question",
        F.struct(labels.alias("label"), texts.alias("text")).alias("choices"),
        F.col("g").alias("answerKey"), "lang", "source",
    )


def gsm8k_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _doc_base(documents(spark, sf_dir)).where(F.col("task") == "gsm8k")
    return base.select(
        F.col("doc_id").alias("id"), "question",
        F.concat(F.lit("so #### "), F.col("g")).alias("answer"), "lang", "source",
    )


def math_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _doc_base(documents(spark, sf_dir)).where(F.col("task") == "math")
    return base.select(
        F.col("doc_id").alias("id"), F.col("question").alias("problem"),
        F.col("g").alias("answer"), (F.col("doc_id") % 5 + 1).cast("int").alias("level"),
        F.col("lang").alias("subject"), "lang", "source",
    )


def prompts(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """One prompt row per document: (id, question, gold, task, lang, source), with ``by`` as in ``traces``."""
    base = _doc_base(dealt_documents(spark, sf_dir, by) if by else documents(spark, sf_dir))
    gold = F.when(F.col("task") == "gsm8k", F.concat(F.lit("so #### "), F.col("g"))).otherwise(F.col("g"))
    return base.select(F.col("doc_id").alias("id"), "question", gold.alias("gold"), "task", "lang", "source", *([by] if by in base.columns else []))


def bench_items(spark: SparkSession, sf_dir: str) -> dict:
    return {
        "arc_c": arc_items(spark, sf_dir),
        "gsm8k": gsm8k_items(spark, sf_dir),
        "math_500": math_items(spark, sf_dir),
    }
