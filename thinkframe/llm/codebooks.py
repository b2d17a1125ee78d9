"""Vector compression by codebooks, with k-means under norm-of-sum bounds.

Components become integers and vectors are cut into equal parts; every part
position has a codebook of its own. A round assigns each part to the nearest
entry, then moves the entries to the floor of their parts' means. All sums and
distances are integers, so results do not depend on partitions or order.

The driver keeps every round's codebooks (entries x components integers a
round; nothing that grows with the rows). A part keeps its entry, a lower bound
of the distance to all other entries, and the round that bound was measured
in. Later the bound is lowered by the largest *net* displacement of another
entry since that round, ``|c_now - c_then|``, the norm of the sum of its moves;
the sum of their norms, which bounds by accumulated drift would take off, is
never less. If the part's own entry is nearer than that, nothing can have
changed; else all entries are measured again and the bound gets a new stamp.
Means are updated by the parts that changed their entry alone.

Each pass is one map over the rows, written as a table with its bounds; the
sums of a pass leave each task as one row per component of an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import written

SCALE = 256
LARGEST = 1 << 26  # components beyond it are held at it, so that errors fit in 64 bits
ROWS = 4096  # of a batch measured at once
EXACT = float(1 << 52)  # up to which doubles hold integers, with room


@dataclass
class Codebooks:
    """``entries``: (parts, entries, components of a part) integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integers(vector: str) -> Column:
    """floor(256 * x) of every component; null if the vector is null or has a
    component that is null or not finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))).cast("int"))
    return F.when(finite, whole)


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows x entries) exact squared distances of integers."""
    top = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * float(top) ** 2 * max(1, x.shape[1]) < EXACT:
        p, q = x.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ q.T) + (q * q).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in entries], axis=1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, distance of the nearest other one)."""
    d = squared_distances(x, entries)
    rows = np.arange(len(x))
    code = d.argmin(axis=1)  # the lowest index of equal ones
    least = d[rows, code]
    d[rows, code] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(axis=1).astype(np.float64)) if len(entries) > 1 else np.full(len(x), np.inf)
    return code, least, other


def net_displacements(history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's codebooks round by round (rounds x entries x components): for
    each round the entry that is farthest from its place then, its distance,
    and the largest distance of another entry."""
    moved = np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(axis=2))
    far = moved.argmax(axis=1)
    rounds = np.arange(len(history))
    first = moved[rounds, far]
    moved[rounds, far] = 0
    return far, first, moved.max(axis=1)


def reassigned(x: np.ndarray, history: np.ndarray, code: np.ndarray, lower: np.ndarray, stamp: np.ndarray):
    """(code, squared distance, lower, stamp, number scanned again) of a part's
    rows under the last codebook of ``history``."""
    entries, now = history[-1], len(history) - 1
    own = ((x - entries[code]) ** 2).sum(axis=1)
    far, first, second = net_displacements(history)
    drift = np.where(far[stamp] == code, second[stamp], first[stamp])
    bound = lower * (1 - 1e-9) - drift * (1 + 1e-9)  # roots are rounded
    again = np.flatnonzero(~(np.sqrt(own.astype(np.float64)) < bound))
    if len(again):
        code, lower, stamp = code.copy(), lower.copy(), stamp.copy()
        code[again], own[again], lower[again] = scan(x[again], entries)
        stamp[again] = now
    return code, own, lower, stamp, len(again)


STATE = "k long, label {label}, v binary, code binary, lower binary, stamp binary, error long, cell long, value long"


def _assigned(rows: DataFrame, history: np.ndarray, label: str, first: bool, last: bool) -> DataFrame:
    """``rows`` (k, label, v, and code, lower, stamp after the first pass) with
    the state after the last codebooks of ``history`` (rounds x parts x entries
    x components). Rows with a ``cell`` are a task's changes of sums, of counts
    (cells from the number of components on) and, last, its scanned parts."""
    _, parts, entries, size = history.shape
    schema = STATE.format(label=label)
    names = ["k", "label", "v", "code", "lower", "stamp", "error", "cell", "value"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, scanned = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64), 0

        def change(part: int, x: np.ndarray, code: np.ndarray, sign: int) -> None:
            counts[part] += sign * np.bincount(code, minlength=entries)
            for j in range(size):
                sums[part, :, j] += sign * np.bincount(code, weights=x[:, j], minlength=entries).astype(np.int64)

        kinds = None
        for whole in batches:
            kinds = whole.schema.field(1).type
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(n, parts, size).astype(np.int64)
                code, lower, stamp = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts), np.uint8)
                error = np.zeros(n, np.int64)
                if not first:
                    old, below, since = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(n, parts) for i, kind in ((3, "u1"), (4, "<f8"), (5, "u1")))
                for p in range(parts):
                    if first:
                        code[:, p], own, lower[:, p] = scan(x[:, p], history[-1, p])
                        scanned += n
                        change(p, x[:, p], code[:, p], 1)
                    else:
                        code[:, p], own, lower[:, p], stamp[:, p], again = reassigned(x[:, p], history[:, p], old[:, p].astype(np.int64), below[:, p], since[:, p])
                        scanned += again
                        moved = np.flatnonzero(code[:, p] != old[:, p])
                        change(p, x[moved, p], code[moved, p], 1)
                        change(p, x[moved, p], old[moved, p], -1)
                    error += own
                none = pa.nulls(n, pa.int64())
                blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (code, lower, stamp)]
                state = [blobs[0], pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())] if last else blobs
                v = pa.nulls(n, pa.binary()) if last else batch.column(2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v, *state, pa.array(error), none, none], names=names)
        if kinds is not None:
            values = np.concatenate([sums.reshape(-1), counts.reshape(-1), [scanned]])
            some = np.flatnonzero(values)
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, kinds), *[pa.nulls(n, pa.binary())] * 4, pa.nulls(n, pa.int64()), pa.array(some), pa.array(values[some])], names=names)

    return rows.mapInArrow(assign, schema)


def _packed(rows: DataFrame, width: int, label: str) -> DataFrame:
    """(k, label, v): integers as bytes, padded with zeros to ``width``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            v = []
            for end, n in zip(np.cumsum(lengths), lengths, strict=True):
                v.append(values[end - n : end].tobytes() + bytes(4 * (width - n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.binary())], names=["k", "label", "v"])

    return rows.mapInArrow(pack, f"k long, label {label}, v binary")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks, list[int]]:
    """Codes of all vectors, the final codebooks, and how many parts each pass scanned.

    The frame has key, code (an entry's two hex digits per part), error (squared
    distances to the entries, summed over the parts) and label_error (errors
    summed over equal labels; nulls together), one row per kept row.

    Rows whose vector is null or holds a null or non-finite component are
    dropped. Vectors shorter than the longest, and lengths that ``parts`` does
    not divide, are padded with zeros. Codebooks start from the smallest keys
    (null last; rows that repeat a key by their components); with fewer kept
    rows than ``entries`` they have that many entries. Repeated rows count
    each. No kept row: an empty frame and empty codebooks. Other columns are
    not read. At most 256 entries and 255 rounds.
    """
    if not (1 <= entries <= 256 and parts >= 1 and 0 <= rounds <= 255):
        raise ValueError("entries must be 1 to 256, parts at least 1 and rounds 0 to 255")
    spark, kind = df.sparkSession, df.schema[label].dataType.simpleString()
    kept = df.select(F.col(key).cast("long").alias("k"), F.col(label).alias("label"), integers(vector).alias("x")).where("x IS NOT NULL")
    kept = written(kept, "kept-vectors")
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        empty = spark.createDataFrame([], f"`{key}` long, code string, error long, label_error long")
        return empty, Codebooks(np.zeros((parts, 0, 0), np.int64)), []
    size = -(-longest // parts)
    start = [r["x"] + [0] * (parts * size - len(r["x"])) for r in kept.orderBy(F.col("k").asc_nulls_last(), "x").limit(entries).collect()]
    book = np.array(start, np.int64).reshape(len(start), parts, size).transpose(1, 0, 2)
    state, history = _packed(kept, parts * size, kind), [book]
    sums, counts, scans = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64), []
    for turn in range(rounds + 1):
        rows = state.select("k", "label", "v", *(["code", "lower", "stamp"] if turn else []))
        whole = written(_assigned(rows, np.stack(history), kind, turn == 0, turn == rounds), f"codes-{turn}")
        state = whole.where("cell IS NULL")
        change = np.zeros(sums.size + counts.size + 1, np.int64)
        for r in whole.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            change[r["cell"]] = r["value"]
        scans.append(int(change[-1]))
        sums, counts = sums + change[: sums.size].reshape(sums.shape), counts + change[sums.size : -1].reshape(counts.shape)
        if turn < rounds:
            used = counts > 0
            history.append(np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], history[-1]))

    labels = state.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = state.join(labels, F.col("label").eqNullSafe(F.col("l")))
    out = out.select(F.col("k").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error")
    return out, Codebooks(history[-1]), scans
