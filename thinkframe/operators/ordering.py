"""Order-dependent operators without a single-task sort.

* ``seeded_hash`` gives every row a repeatable pseudo-random position
  (md5 of seed and key, so DuckDB can reproduce it);
* ``nth_smallest_hash`` finds the exact n-th smallest hash by histogram
  refinement, 16 bits at a time: each pass is one distributed aggregation
  returning at most 65,536 counts, the same passes at every table size;
* ``first_n`` is the source-order limit (a top-k, TakeOrderedAndProject);
* ``exact_quantiles`` finds several order statistics of many groups at once
  from counted values: ranges are counted, and only those that hold a wanted
  rank are looked into.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.session import written

LEVEL_DIGITS = 4  # hex digits of an md5 that one refinement pass resolves


def seeded_hash(seed: int, key) -> Column:
    """Hex md5 of ``"{seed}:{key}"``: a seeded, repeatable shuffle position."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k))


def nth_smallest_hash(df: DataFrame, md5_col: str, n: int | Callable[[int], int]) -> str | None:
    """Exact ``n``-th smallest (1-based) value of a hex-md5 column, or None if n < 1.

    ``n`` may be a function of the number of rows, which the first pass counts.

    ``df`` should be materialised and narrow: each level is one pass over it.
    A level counts the rows per next four hex digits below the prefix found so
    far; the passes end when one value is left. Equal hashes count as often as
    they occur. Raises ValueError if there are fewer than ``n`` rows.
    """
    if not callable(n) and n < 1:
        return None
    prefix, need = "", n
    while True:
        below = df.select(F.col(md5_col).alias("m"))
        below = below.where(F.col("m").startswith(prefix)) if prefix else below
        digits = F.substring("m", len(prefix) + 1, LEVEL_DIGITS)
        counts = below.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi")).collect()
        if callable(need):
            need = need(sum(row["n"] for row in counts))
            if need < 1:
                return None
        found = None
        for row in sorted(counts, key=lambda r: r["d"]):
            if row["n"] >= need:
                found = row
                break
            need -= row["n"]
        if found is None:
            raise ValueError(f"fewer than {n} rows to take the {n}-th smallest hash of")
        if found["lo"] == found["hi"]:
            return found["lo"]
        prefix += found["d"]


def first_n(df: DataFrame, order_cols: Sequence[str], n: int | None) -> DataFrame:
    """L1: first ``n`` rows in source order (clamped); ``None`` keeps all rows."""
    if n is None:
        return df
    return df.orderBy(*order_cols).limit(max(0, n))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def exact_quantiles(counts: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], count: str = "n") -> DataFrame:
    """(by, ``q0``, ``q1`` ...): exact quantiles per group, with linear
    interpolation between neighbours as ``percentile`` has it.

    ``counts``: each (by, value) once with its count, as a written table; null
    values do not count. A range exchange cuts the distinct values into ordered
    ranges, whatever their number; ranges are counted per group, those that
    hold a wanted rank are found on the counts, and running counts are taken
    inside these ranges alone. So no task holds the values of a whole group.
    """
    rows = counts.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("x"), F.col(count).alias("n"))
    ranged = written(rows.repartitionByRange(*by, "x").withColumn("p", F.spark_partition_id()), "value-ranges")
    run = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranged.groupBy(*by, "p").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(run))
    ranges = written(ranges.withColumn("total", F.sum("m").over(Window.partitionBy(*by))), "range-counts")

    # ranks from 0: the two neighbours of each quantile
    place = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for i, q in enumerate(probs)])
    wanted = ranges.select(*by, "total").distinct().select(*by, F.inline(place))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("at").alias("rank")))
    wanted = wanted.select(*[F.col(c).alias(f"_{c}") for c in by], "i", "at", F.inline(ends))
    holds = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m"))
    wanted = ranges.join(wanted, _same(by, [f"_{c}" for c in by]) & holds).select(*by, "p", "i", "side", "at", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
    wanted = written(wanted, "wanted-ranks")
    hit = wanted.select(*[F.col(c).alias(f"_{c}") for c in (*by, "p")]).distinct()
    inside = ranged.join(hit, _same([*by, "p"], [f"_{c}" for c in (*by, "p")]), "left_semi")
    below = Window.partitionBy(*by, "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("c", F.sum("n").over(below))
    asked = wanted.select(*[F.col(c).alias(f"_{c}") for c in (*by, "p")], "i", "side", "at", "rank")
    found = inside.join(asked, _same([*by, "p"], [f"_{c}" for c in (*by, "p")]) & (F.col("rank") < F.col("c")) & (F.col("rank") >= F.col("c") - F.col("n")))
    x = F.col("x").cast("double")
    pair = found.groupBy(*by, "i").agg(F.max(F.when(F.col("side") == 0, x)).alias("lo"), F.max(F.when(F.col("side") == 1, x)).alias("hi"), F.max("at").alias("at"))
    part = F.col("at") - F.floor("at")
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.lit(1) - part) * F.col("lo") + part * F.col("hi"))
    return pair.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, between)).alias(f"q{i}") for i in range(len(probs))])
