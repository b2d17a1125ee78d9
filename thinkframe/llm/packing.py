"""Best-fit packing of token sequences under several capacities.

Longer documents are cut into pieces of at most ``max_tokens``. Every piece
is a vector (tokens, documents, attention cost = tokens squared) and every
sequence a bin with a capacity in each. Pieces are placed in descending
order; of the bins with room in every dimension, the one with the smallest
weighted residual norm (``rule="norm"``, best fit) or the largest weighted
dot product of piece and residual (``rule="dot"``) takes it.

Packing needs only lengths, so narrow rows travel. They are dealt evenly,
whatever their keys, into groups of about ``group_pieces`` rows; each group
packs on its own (a group ends with at most a few bins that are not full).
The number of groups follows the table, never the cluster.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import written
from thinkframe.llm.tokens import encoder

GROUP_PIECES = 16_384


def token_pieces(docs: DataFrame, vocabulary: str, max_tokens: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) per piece of every document.

    Null texts are empty (one piece: the end id). The pieces after the first
    all have ``max_tokens`` tokens; the first takes what is left over.
    Rows with equal keys each give their own pieces.
    """
    end = int(end_id).to_bytes(4, "little")
    names = ["k", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_text = encoder(vocabulary).ids
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of_text(t.as_py()) + end
                n = len(ids) // 4
                first = n - (-(-n // max_tokens) - 1) * max_tokens
                bounds = [0, *range(first, n + 1, max_tokens)]
                rows += [(k, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    pieces = docs.select(F.col(key).cast("long"), F.col(text)).toDF("k", "t").mapInArrow(cut, "k long, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumnRenamed("k", key)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin number of every row of ``sizes`` (rows x dimensions, fitting ``capacity``).

    Rows are taken as they come; the caller orders them. Ties go to the bin
    that was opened first.
    """
    weights = weights / np.maximum(capacity, 1) ** 2  # dimensions count alike whatever their units
    bins = np.zeros(len(sizes), np.int64)
    room = np.zeros((len(capacity), 1024))  # a row per dimension: its residuals lie side by side
    number = np.zeros(1024, np.int64)
    opened = alive = 0
    smallest = np.minimum.accumulate(sizes[::-1], axis=0)[::-1] if len(sizes) else sizes
    for i, size in enumerate(sizes):
        if i % 256 == 0 and alive:  # bins without room for anything that follows
            stay = np.flatnonzero((room[:, :alive] >= smallest[i][:, None]).all(axis=0))
            room[:, : len(stay)], number[: len(stay)], alive = room[:, stay], number[stay], len(stay)
        good = room[0, :alive] >= size[0]
        for d in range(1, len(capacity)):
            good &= room[d, :alive] >= size[d]
        fits = good.nonzero()[0]
        if len(fits):
            score = np.zeros(len(fits))
            for d, weight in enumerate(weights):
                left = room[d, fits]
                if rule == "norm":
                    left -= size[d]
                    left *= left
                    score += weight * left
                else:
                    score -= (weight * size[d]) * left
            best = fits[score.argmin()]
        else:
            if alive == room.shape[1]:
                room, number = np.concatenate([room, np.zeros_like(room)], axis=1), np.concatenate([number, np.zeros_like(number)])
            best = alive
            room[:, best], number[best] = capacity, opened
            alive, opened = alive + 1, opened + 1
        room[:, best] -= size
        bins[i] = number[best]
    return bins


def pack(pieces: DataFrame, max_tokens: int, max_documents: int, max_attention: int, length: str = "length", order: tuple[str, ...] = (),
         weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless place in the sequence).

    ``pieces`` should be a written table (it is counted, then dealt). Every
    ``length`` must be 1..max_tokens and fit ``max_attention`` alone, or the
    job stops. Columns named ``sequence_id`` or ``offset`` are replaced.
    Deterministic: Spark deals the rows by their contents, and within a group
    they are ordered by length, then ``order``.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, -(-pieces.count() // group_pieces))
    capacity = np.array([max_tokens, max_documents, max_attention], float)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(frames)  # one group: about group_pieces rows
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        rows = rows.sort_values([length, *order], ascending=[False] + [True] * len(order), kind="stable", ignore_index=True)
        n = rows[length].to_numpy(np.int64)
        sizes = np.stack([n, np.ones_like(n), n * n], axis=1).astype(float)
        if len(n) and (n.min() < 1 or (sizes > capacity).any()):
            raise ValueError("a piece is empty or larger than a sequence")
        full = int((n == max_tokens).sum())  # they come first, each a sequence of its own
        bins = np.concatenate([np.arange(full), full + best_fit(sizes[full:], capacity, np.array(weights), rule)])
        by_bin = np.argsort(bins, kind="stable")
        before = np.cumsum(n[by_bin]) - n[by_bin]
        first = np.concatenate([[True], np.diff(bins[by_bin]) > 0])
        offset = np.empty(len(n), np.int64)
        offset[by_bin] = before - np.maximum.accumulate(np.where(first, before, 0))
        yield rows.assign(sequence_id=bins + (TaskContext.get().partitionId() << 32), offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.repartition(groups).mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int, end_id: int, max_documents: int, max_attention: int,
                   key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Cut, then pack whole documents: every piece with its sequence and place."""
    pieces = written(token_pieces(docs, vocabulary, max_tokens, end_id, key, text), "pieces")
    return pack(pieces, max_tokens, max_documents, max_attention, order=(key, "piece"), **how)
