"""Running sums, minima and maxima within groups of any size.

A window over a group runs in one task. Here a group's positions are cut into
ranges of ``RANGE``; each range is aggregated (partially, where it is read), a
window over the few ranges of a group carries their values forward, and the
window over single rows stays within a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096  # positions per range

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def _both(kind: str, before: Column, own: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + own
    return (F.least if kind == "min" else F.greatest)(before, own)  # nulls do not count


def running(df: DataFrame, by: Sequence[str], pos: str, values: Mapping[str, tuple[str, Column | str]], then: Sequence[str] = (), own: bool = True, last: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``values`` (kind, value), the ``sum``,
    ``min`` or ``max`` of the value over the rows of the group ``by`` up to
    each row, in order of ``pos`` (a whole number), then of ``then``; without
    the row itself if not ``own`` (for minima and maxima).

    ``last``: the largest position, if known; when all lie in the first range,
    nothing needs to be carried and a window over the group is all there is.
    ``pos`` and ``then`` should tell the rows of a group apart. Null group
    columns are values like others. A sum ignores nulls; it is null up to the
    first value of a group.
    """
    if last is not None and last < RANGE:
        window = Window.partitionBy(*by).orderBy(pos, *then).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        return df.select("*", *[_AGGREGATE[k](v).over(window).alias(n) for n, (k, v) in values.items()])
    ranged = df.select("*", F.floor(F.col(pos) / RANGE).alias("__range"), *[(F.col(v) if isinstance(v, str) else v).alias(f"__v_{n}") for n, (_, v) in values.items()])
    totals = ranged.groupBy(*by, "__range").agg(*[_AGGREGATE[k](f"__v_{n}").alias(f"__t_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__at"),
        F.row_number().over(Window.partitionBy(*by).orderBy("__range")).alias("__nth"),
        *[_AGGREGATE[k](f"__t_{n}").over(earlier).alias(f"__b_{n}") for n, (k, _) in values.items()],
    ).where("__nth > 1")  # few groups have a second range
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__range") == F.col("__at"))
    inside = Window.partitionBy(*by, "__range").orderBy(pos, *then).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = ranged.join(before, same, "left")
    return out.select(*df.columns, *[_both(k, F.col(f"__b_{n}"), _AGGREGATE[k](f"__v_{n}").over(inside)).alias(n) for n, (k, _) in values.items()])
