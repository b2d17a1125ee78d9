"""Vectors as packed bytes: validity, exact cosine, classes of equal vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element_type(df: DataFrame, vector: str) -> str:
    """numpy type of the packed components: what the column holds, floats stay floats."""
    kind = df.schema[vector].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def taking_part(vector: str) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packed_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row per distinct key, ``v`` its components' bytes.

    ``v`` is null where the vector takes no part (see ``taking_part``) or the
    key is null. Rows that repeat a key count once, with the smallest bytes.
    """
    kind = element_type(df, vector)
    width = 4 if kind == "<f4" else 8

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=kind).view(np.uint8)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * width
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            rows = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
            rows = pa.array([None if n == 0 else r for n, r in zip(sizes, rows.to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["id", "v"])

    element = "float" if kind == "<f4" else "double"
    good = F.when(taking_part(vector), F.col(vector).cast(f"array<{element}>"))
    rows = df.select(F.col(key).cast("long").alias("id"), good.alias("x")).mapInArrow(pack, "id long, v binary")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows.withColumn("v", F.when(F.col("id").isNotNull(), F.col("v")))


def lengths(packed: DataFrame) -> list[int]:
    """The lengths in bytes of the vectors that take part, ascending. Operators
    do one length after the other: vectors of different lengths have no cosine."""
    return sorted(r["n"] for r in packed.where("v IS NOT NULL").select(F.length("v").alias("n")).distinct().collect())


def matrix(column, kind: str) -> np.ndarray:
    """Rows x components in double precision."""
    rows = [bytes(x) for x in column]
    if not rows:
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of ``a`` and ``b``, in double precision, always summed alike."""
    top = (a * b).sum(axis=1)
    below = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    plain = (below > 1e-290) & (below < 1e290)
    if plain.all():
        return top / below
    p, q = unit(a), unit(b)
    return np.where(plain, top / np.where(plain, below, 1), (p * q).sum(axis=1))
