"""Shared pieces of the training-data operators.

* ``written``: cut lineage with a Parquet table in the cluster's shared
  checkpoint folder, so a lost executor costs a re-read, not a recomputation;
* vectorised word and shingle hashing over the UTF-8 bytes of Arrow columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.session import shared_path

# White space of the word contracts: space and \t \n \v \f \r.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SEGMENT = 1 << 20  # bytes hashed at once; bounds the temporary arrays
CHUNK_BYTES = 1 << 20  # bytes of documents handled together
CHUNK_ROWS = 512  # and rows, at most


FILTER_BITS = 1 << 23  # of the broadcast set of keys (1 MB, whatever the input)
FILE_ROWS = 500_000  # rows of a narrow table per file


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    ``rows``: a bound of its rows, known from the table it comes from; the
    table then has a file per FILE_ROWS of them instead of one per task.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_bits(keys: DataFrame, key: str) -> np.ndarray:
    """A bit array of fixed size in which the bit of every key is set."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    rows = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {FILTER_BITS}) & 63 as int))").alias("bit"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        words[r["w"]] = r["bits"]
    return words.view(np.uint64)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``keys`` (distinct, written).

    Rows move only where the bit of their key is set; the others, most of them
    while the keys are few, stay where they are read. With many keys all bits
    are set and this is a plain anti-join.
    """
    shared = df.sparkSession.sparkContext.broadcast(key_bits(keys, key))

    @F.pandas_udf("boolean")
    def maybe(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    marked = df.withColumn("__maybe", maybe(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))))
    stays = marked.where("not __maybe").drop("__maybe")
    return stays.union(marked.where("__maybe").drop("__maybe").join(keys.select(key), key, "left_anti").select(*df.columns))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null reads as an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def doc_chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for row ranges of a string column whose
    texts have about ``limit`` bytes (one row at least); the offsets are those
    of the range's rows. Only a range at a time is copied."""
    for start in range(0, len(column), rows):
        data, offsets = utf8(column.slice(start, rows))
        at, n = 0, len(offsets) - 1
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(n, max(at + 1, end))
            yield start + at, start + end, data, offsets[at : end + 1]
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of the white-space separated words of UTF-8 texts.

    A word's hash is a polynomial over random byte values modulo 2**64, taken
    from prefix sums, so that all words of a segment are hashed by a few array
    operations. ``fold`` lower-cases A-Z (only) first.
    """

    BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted

    def __init__(self, fold: bool = True):
        rng = np.random.Generator(np.random.PCG64(20240501))
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.word = np.ones(256, bool)
        self.word[list(SPACE_BYTES)] = False
        self._grow(SEGMENT)

    def _grow(self, n: int) -> None:
        inverse = np.uint64(pow(self.BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.full(n + 1, self.BASE, np.uint64))
            self.down = np.multiply.accumulate(np.full(n + 1, inverse, np.uint64))

    def _segment(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.word[b]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        if len(b) > len(self.up):
            self._grow(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.up[: len(b)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.down[starts]), starts

    def words(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, start offsets) of all words; long texts go by segments cut at white space."""
        if len(b) <= SEGMENT:
            return self._segment(b)
        found, at = [], 0
        while at < len(b):
            end = min(len(b), at + SEGMENT)
            while end < len(b) and self.word[b[end - 1]] and self.word[b[end]]:
                ahead = np.flatnonzero(~self.word[b[end : end + SEGMENT]])
                end = end + int(ahead[0]) if len(ahead) else min(len(b), end + SEGMENT)
            hashes, starts = self._segment(b[at:end])
            found.append((hashes, starts + at))
            at = end
        return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])

    def documents(self, data: np.ndarray, offsets: np.ndarray):
        """Per-word hashes of the rows that ``offsets`` bound, and the words' row bounds.

        Returns (hashes, bounds): row i's words are hashes[bounds[i]:bounds[i+1]].
        """
        lengths = np.diff(offsets)
        n = len(lengths)
        # a space after every row keeps words of neighbouring rows apart
        joined = np.full(int(lengths.sum()) + n, 0x20, np.uint8)
        own = np.zeros(n + 1, np.int64)
        np.cumsum(lengths + 1, out=own[1:])
        if n == 1:
            joined[: lengths[0]] = data[offsets[0] : offsets[-1]]
        else:
            keep = np.ones(len(joined), bool)
            keep[own[1:] - 1] = False
            joined[keep] = data[offsets[0] : offsets[-1]]
        hashes, starts = self.words(joined)
        return hashes, np.searchsorted(starts, own)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``n``-word shingles; fewer words make one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(words) < n:
            h = np.uint64(len(words))
            for w in words:
                h = mix64(np.array([h * np.uint64(0xD6E8FEB86659FD93) + w], np.uint64))[0]
            return np.array([h], np.uint64)
        h = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
            h ^= h >> np.uint64(32)
        return np.unique(mix64(h))
