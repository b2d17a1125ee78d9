"""Sources and sinks (S1-S7) with explicit schemas and source order.

Record files are JSON Lines. Every read carries its place in the source
(``SOURCE_ORDER``) because file order decides keep-first dedupe,
caps and vote tie-breaks, and Spark rows have no order of their own.
Parquet is the default at-rest format for intermediate tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Record schemas (Spark DDL).
TEACHER_RECORD = (
    "id string, question string, gold string, traces array<string>, "
    "meta map<string,string>"
)
FILTERED_RECORD = "id string, question string, gold string, trace string, answer string, meta map<string,string>"
SFT_RECORD = "prompt string, response string, task string, meta map<string,string>"
RL_PROMPT = "prompt string, gold string, task string"
SAMPLE_RECORD = (
    "id string, question string, gold string, trace string, answer string, "
    "meta struct<task:string, teacher:string>"
)
EVAL_SUMMARY = "acc double, n long"


# Columns that ``read_jsonl`` adds; sorted by them, records stand in source order.
SOURCE_ORDER = ("src_file_no", "src_file", "src_block", "src_pos")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-redistribute a scan that yields fewer splits than the cluster has cores.

    A small file with one row group, or one compressed (unsplittable) file,
    is read by one task, and all per-row text work after it would run on one
    core. Large inputs already have more splits than cores and are left
    alone (no extra shuffle). Apply it after any source ordinal is assigned;
    ``keys`` should tell rows apart, so that no key gathers many rows.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, *keys)
    return df


def read_jsonl(spark: SparkSession, paths, schema: str | T.StructType) -> DataFrame:
    """JSON Lines with a fixed schema (no inference pass); blank lines skipped.

    A line that is no JSON record of the schema stops the job. Adds the columns
    of ``SOURCE_ORDER``: the path's place in ``paths``, the file, the split's
    offset in it, and an ordinal that grows within the split.
    """
    parts = []
    for i, path in enumerate([paths] if isinstance(paths, str) else list(paths)):
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        parts.append(df.select(
            "*",
            F.lit(i).alias("src_file_no"),
            F.col("_metadata.file_path").alias("src_file"),
            F.col("_metadata.file_block_start").alias("src_block"),
            F.monotonically_increasing_id().alias("src_pos"),
        ))
    return reduce(DataFrame.unionByName, parts)


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """Text lines with their true places: ``value``, ``src_file_no``,
    ``src_file``, ``src_line`` (in its file, from 0) and ``src_ordinal`` (over all
    files: paths in the given order, files of a path by name).

    Files are read in splits, and rows have no number of their own: the lines
    of every split are counted first, and the counts of earlier splits and
    files are added to a line's place in its split. So numbers are the same
    under any split size; blank lines count.
    """
    lines = None
    for i, path in enumerate([paths] if isinstance(paths, str) else list(paths)):
        df = spark.read.text(path).select(
            "value", F.lit(i).alias("src_file_no"), F.col("_metadata.file_path").alias("src_file"),
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
        )
        lines = df if lines is None else lines.union(df)
    split = ["src_file_no", "src_file", "_block"]
    counts = lines.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row per split
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("src_file_no", "src_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counts.groupBy("src_file_no", "src_file").agg(F.sum("_n").alias("_lines"))
    # a row per file; its window over all of them is as long as the list of files that the driver has planned
    earlier = F.coalesce(F.sum("_lines").over(Window.orderBy("src_file_no", "src_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).join(files.withColumn("_earlier", earlier), ["src_file_no", "src_file"])
    starts = starts.select(*split, (F.col("_before") - F.col("_first")).alias("_in_file"), (F.col("_earlier") + F.col("_before") - F.col("_first")).alias("_in_all"))
    placed = lines.join(F.broadcast(starts), split)  # a row per split; the lines stay where they are read
    return placed.select("value", "src_file_no", "src_file", (F.col("_id") + F.col("_in_file")).alias("src_line"), (F.col("_id") + F.col("_in_all")).alias("src_ordinal"))


def read_numbered_jsonl(spark: SparkSession, paths, schema: str | T.StructType) -> DataFrame:
    """S1 with true line numbers (``src_line``, ``src_ordinal``, see
    ``numbered_lines``); blank lines are skipped but counted.

    A line that is no JSON record of the schema stops the job, once it is read.
    """
    lines = numbered_lines(spark, paths).where(F.col("value").rlike(r"\S"))
    record = F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"})
    return lines.withColumn("_r", record).select("_r.*", "src_file_no", "src_file", "src_line", "src_ordinal")


def read_shards(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType) -> DataFrame:
    """S2 + U1: shards concatenated in the given order (``shard_no``)."""
    return read_jsonl(spark, paths, schema).withColumn("shard_no", F.col("src_file_no"))


def write_jsonl(df: DataFrame, path: str, order_by: Sequence[str] = (), columns: Sequence[str] | None = None, compression: str | None = None) -> None:
    """S3: JSON Lines, UTF-8 kept raw, NULL fields written; parents created.

    ``order_by`` sorts the output (a range-partitioned sort, not one task).
    ``columns`` are the fields to write (default: all), so that the order
    columns need not become fields. ``compression``: e.g. ``gzip``; the readers
    find it by the files' names, and a file of it is read by one task.
    """
    out = df.orderBy(*order_by) if order_by else df
    out = out.select(*columns) if columns else out
    writer = out.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.option("compression", compression) if compression else writer).json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet table (the default at rest), optionally partitioned (e.g. by task)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_prompts(spark: SparkSession, path: str, prompt_field: str = "prompt", schema: str | T.StructType | None = None) -> DataFrame:
    """Prompt table, the prompt column renamed to ``prompt`` when needed.

    With a ``schema`` there is no inference pass; without one, fields are found
    by reading the file first (their names are the user's).
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("mode", "FAILFAST").json(path)
    return df.withColumnRenamed(prompt_field, "prompt") if prompt_field != "prompt" else df


def read_train_eval(spark: SparkSession, train_path: str, eval_path: str | None = None,
                    schema: str = SFT_RECORD) -> tuple[DataFrame, DataFrame | None]:
    """Train table and an optional eval table.

    The eval table is None when its path is missing or any of its lines cannot
    be read; a train line that cannot be read stops the job.
    """
    train = spark.read.schema(schema).option("mode", "FAILFAST").json(train_path)
    if not eval_path:
        return train, None
    try:
        marked = spark.read.schema(f"{schema}, _corrupt_record string").json(eval_path)
        broken = marked.where(F.col("_corrupt_record").isNotNull()).select("prompt", "_corrupt_record").head(1)
    except AnalysisException:
        return train, None
    return train, None if broken else spark.read.schema(schema).json(eval_path)


def write_eval(rows: DataFrame, path: str) -> DataFrame:
    """Item rows as Parquet under ``path/rows``, the summary as one JSON row.

    The summary is taken from the rows as written, so they are computed once.
    """
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    summary = rows.sparkSession.read.parquet(f"{path}/rows").agg(
        (F.count_if(F.col("correct")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("acc"),
        F.count(F.lit(1)).alias("n"),
    )
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return read_summary(rows.sparkSession, path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary row that ``write_eval`` left under ``path``."""
    return spark.read.schema(EVAL_SUMMARY).json(f"{path}/summary")


def read_eval_results(spark: SparkSession, root: str) -> DataFrame:
    """(bench, model, acc) from ``root/{bench}.{model}/summary``.

    A missing or broken summary simply has no row; the report's left join
    then prints ``n/a`` for that cell.
    """
    try:
        df = spark.read.schema(EVAL_SUMMARY + ", _corrupt_record string").json(f"{root}/*/summary")
    except AnalysisException:
        return spark.createDataFrame([], "bench string, model string, acc double")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/summary/[^/]+$", 1)
    return df.where(F.col("_corrupt_record").isNull()).select(
        F.substring_index(run, ".", 1).alias("bench"),
        F.regexp_replace(run, r"^[^.]*\.", "").alias("model"),  # a model tag may hold dots
        F.col("acc"),
    )
