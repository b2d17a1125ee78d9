"""Token-id files with bit-plane shuffling.

Documents in ascending order of their key become token ids, one end id after
each. A file holds whole documents: a header, a document index, and the ids
cut into fixed-size blocks. Each block is transposed into byte planes (all
lowest bytes, then all second bytes, ...) or bit planes, every plane is
compressed with zstandard on its own, and a chunk index keeps each plane's
place, so that a reader can fetch a block or a document without the rest.

Spark writes the files (its commit protocol makes a retried task harmless):
one record of raw bytes per file through the text sink, whose line separator
is the format's closing byte. They are read back with the binaryFile source.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thinkframe.llm.common import written
from thinkframe.llm.tokens import encoder

MAGIC = b"TFIDS1\n"
CLOSE = "\n"  # one byte after the record
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 21


def planes_of(ids: np.ndarray, unit: str) -> list[bytes]:
    """Byte or bit planes of a block of unsigned 32-bit ids, lowest first."""
    bytes_ = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if unit == "byte":
        return [p.tobytes() for p in bytes_]
    bits = np.unpackbits(bytes_[:, :, None], axis=2, bitorder="little")
    return [np.packbits(bits[k // 8, :, k % 8]).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    """The inverse of ``planes_of``."""
    if unit == "byte":
        grid = np.frombuffer(b"".join(planes), np.uint8).reshape(4, n)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
        grid = np.packbits(bits.reshape(4, 8, n), axis=1, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(grid.T).view("<u4").reshape(-1)


def pack_file(part: int, seq: int, keys: list, lengths: list[int], ids: bytes, unit: str = "byte", block: int = BLOCK_IDS) -> bytes:
    """One file: magic, header size, header (JSON), document index, planes."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    every = np.frombuffer(ids, "<u4")
    index, body, at = [], [], 0
    for start in range(0, len(every), block):
        chunk = every[start : start + block]
        entry = [start, len(chunk)]
        for plane in planes_of(chunk, unit):
            packed = squeeze(plane)
            entry += [at, len(packed)]
            body.append(packed)
            at += len(packed)
        index.append(entry)
    docs = squeeze(json.dumps([keys, lengths]).encode())
    header = json.dumps({"part": part, "seq": seq, "unit": unit, "block": block, "n_ids": len(every), "n_docs": len(keys), "docs": len(docs), "chunks": index}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, docs, *body])


def open_file(content: bytes) -> tuple[dict, list, list[int], int]:
    """(header, document keys, lengths, offset of the planes)."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    at = len(MAGIC) + 4
    size = int.from_bytes(content[len(MAGIC) : at], "little")
    header = json.loads(content[at : at + size])
    at += size
    keys, lengths = json.loads(zstandard.ZstdDecompressor().decompress(content[at : at + header["docs"]]))
    return header, keys, lengths, at + header["docs"]


def read_block(content: bytes, header: dict, base: int, number: int) -> np.ndarray:
    """Ids of one block, found through the chunk index."""
    _, n, *places = header["chunks"][number]
    open_ = zstandard.ZstdDecompressor().decompress
    planes = [open_(content[base + a : base + a + size]) for a, size in zip(places[::2], places[1::2], strict=True)]
    return ids_of(planes, n, header["unit"])


def write_token_files(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text",
                      end_id: int = 0, unit: str = "byte", block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> None:
    """Encode ``docs`` into token-id files under ``path``, ascending by ``key``.

    A range exchange orders the documents over the cluster; each task streams
    its sorted range through the encoder and holds one file's ids at a time
    (``file_ids``, or one longer document). A null text is empty (just the
    end id); null keys come first; rows with equal keys all stay, next to each
    other; other columns are not read. An empty table writes no file records.
    """
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_text = encoder(vocabulary).ids
        part, seq = TaskContext.get().partitionId(), 0
        keys, lengths, parts, total = [], [], [], 0

        def flush():
            payload = pack_file(part, seq, keys, lengths, b"".join(parts), unit, block)
            return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["payload"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of_text(t.as_py()) + end
                keys.append(k)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                total += lengths[-1]
                if total >= file_ids:
                    yield flush()
                    seq, keys, lengths, parts, total = seq + 1, [], [], [], 0
        if keys:
            yield flush()

    ordered = docs.select(F.col(key).cast("long"), F.col(text)).toDF("k", "t").repartitionByRange("k").sortWithinPartitions("k")
    files = ordered.mapInArrow(encode, "payload binary").select(F.col("payload").cast("string"))
    files.write.option("lineSep", CLOSE).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, idx, key, at, n_tokens, ids): every document of the files
    under ``path`` with its place in its file; ``ids`` are its little-endian bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                content = value.as_py()
                if not content:
                    continue
                header, keys, lengths, base = open_file(content)
                ids = np.concatenate([read_block(content, header, base, i) for i in range(len(header["chunks"]))])
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                if bounds[-1] != header["n_ids"] or len(ids) != header["n_ids"]:
                    raise ValueError("the document index and the ids differ in length")
                raw = ids.astype("<u4").tobytes()
                for first in range(0, len(keys), 512):
                    rows = range(first, min(first + 512, len(keys)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([header["part"]] * len(rows), pa.int32()), pa.array([header["seq"]] * len(rows), pa.int32()), pa.array(rows, pa.int32()),
                        pa.array(keys[first : first + 512], pa.int64()), pa.array(bounds[first : rows[-1] + 1], pa.int64()), pa.array(lengths[first : first + 512], pa.int64()),
                        pa.array([raw[4 * bounds[i] : 4 * bounds[i + 1]] for i in rows], pa.binary()),
                    ], names=["part", "seq", "idx", "key", "at", "n_tokens", "ids"])

    content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInArrow(decode, "part int, seq int, idx int, key long, at long, n_tokens long, ids binary")


def token_positions(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, read back from the files: its key, ``start`` (ids of all
    documents before it), ``n_tokens`` and ``ids_crc32``.

    Files' starts are running sums over one row per file.
    """
    docs = read_token_files(spark, path)
    docs = written(docs.select("part", "seq", "key", "at", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-positions")
    files = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", "seq", F.coalesce(before, F.lit(0)).alias("file_start"))
    return docs.join(files, ["part", "seq"]).select(F.col("key").alias(key), (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
