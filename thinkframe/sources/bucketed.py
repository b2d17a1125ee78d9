"""Tables bucketed and sorted by a key, so that joins and first-per-key need no shuffle.

Rows are dealt to a fixed number of buckets by their key when a table is
written; a later join of two tables with the same buckets, or an aggregate per
key, reads bucket beside bucket. Worth it for tables that are joined by the
same key again and again (prompts and their completions, keyed traces).

All rows of a key lie in one bucket. A key that may hold a large part of the
rows should not be bucketed by: ``hot_keys`` tells before the table is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thinkframe.session import shared_path

BUCKET_ROWS = 1_000_000  # rows per bucket when no number of buckets is given


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, with their counts (fewer than 1 / share)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > df.count() * share)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as catalog table ``table`` in buckets of ``keys``, each sorted
    by the keys, then ``order``, in one file; returns it as it reads.

    ``buckets``: given, or one per ``BUCKET_ROWS`` (tables to be joined need the
    same number). ``path``: where its files lie (default: the shared folder).
    The rows are dealt once, by the exchange the write needs.
    """
    if buckets is None:
        buckets = max(1, -(-df.count() // BUCKET_ROWS))
    dealt = df.repartition(buckets, *keys)  # a task per bucket, so a file per bucket
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("compression", "zstd").option("path", path or shared_path(df.sparkSession, table)).saveAsTable(table)
    return df.sparkSession.table(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W1 over a table bucketed by ``keys``: the first row of each key in ``order``.

    A rank inside the bucket, without an exchange; null keys are a key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
