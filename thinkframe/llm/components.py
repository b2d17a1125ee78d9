"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and two joins over the remaining edges, whose
number never grows; every node ends up linked to the smallest node it can
reach. Edges stay in Spark tables; only a row count and a hash sum per round
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import written


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` that is not itself the
    smallest of its component; nodes are longs.

    ``rows``: a bound of the number of edges, if one is known. Loops, repeated
    edges and edges with a null end are ignored. No edges: an empty table.
    """
    pair = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(pair.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges", rows)
    mark = _mark(now)
    while True:  # each round brings every node to a smaller one, or nothing changes
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "stars", mark[0])
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
