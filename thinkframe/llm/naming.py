"""Exact duplicates by deterministic block naming.

1. One pass over the texts deletes white space and cuts what is left, as UTF-8,
   into blocks of ``BLOCK`` bytes. Inside a task equal blocks are sent once:
   they get a number of the task's, and a document keeps its numbers.
2. Blocks are dealt by their content, sorted, and named: equal blocks get one
   integer, different blocks get different ones. The bytes move once and are
   written nowhere.
3. Level by level, neighbouring names (an odd last one beside 0) form pairs;
   the distinct pairs are sorted and named in turn. A document whose names
   are down to one has its identity. Texts of one length have the same number
   of levels, so (length, last name) is the same for two texts if and only if
   the texts are the same: names are given by comparing contents, not by hashes.

A group of copies that holds a third of all rows sends its blocks once per
task; above that all tables are narrow (a row per block), distinct pairs are
pre-aggregated, and what is joined to them is dealt anew by AQE where skewed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import SPACE_BYTES, written

BLOCK = 1024  # bytes
HELD = 1 << 24  # bytes of blocks that a task remembers as sent
SENT = 1 << 22  # bytes of blocks in a batch

CUT = "local long, block binary, row long, k long, points long, length long, text_sha256 string, ids array<long>"
NAMED = "local long, name long, row long, k long, points long, length long, text_sha256 string, ids array<long>"
_FIELDS = [("local", pa.int64()), ("block", pa.binary()), ("row", pa.int64()), ("k", pa.int64()), ("points", pa.int64()),
           ("length", pa.int64()), ("text_sha256", pa.string()), ("ids", pa.list_(pa.int64()))]
_FIRST_ROW = ~((1 << 33) - 1)  # of a task, in the numbers of monotonically_increasing_id


def _cut(size: int, held: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document (local is null) and one per block first met."""
        known: dict[bytes, int] = {}
        known_bytes, number = 0, 0
        schema = pa.schema(_FIELDS)
        for batch in batches:
            docs, blocks, pending = [], [], 0
            points = pc.utf8_length(batch.column(2)).to_pylist()
            texts = batch.column(2).cast(pa.large_binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                text = text.translate(None, bytes(SPACE_BYTES))
                row, ids = batch.column(0)[i].as_py(), []
                for at in range(0, len(text), size):
                    block = text[at : at + size]
                    local = known.get(block)
                    if local is None:
                        if known_bytes > held:
                            known, known_bytes = {}, 0
                        known[block] = local = (row & _FIRST_ROW) + number
                        number += 1
                        known_bytes += len(block) + 100
                        blocks.append((local, block))
                        pending += len(block)
                    ids.append(local)
                docs.append((row, batch.column(1)[i].as_py(), points[i] or 0, len(text), hashlib.sha256(text).hexdigest(), ids))
                if pending > SENT or i == batch.num_rows - 1:
                    yield _rows(schema, docs, blocks)
                    docs, blocks, pending = [], [], 0

    return cut


def _rows(schema: pa.Schema, docs: list, blocks: list) -> pa.RecordBatch:
    none, own = [None] * len(docs), list(zip(*docs, strict=True)) or [()] * 6
    locals_, contents = zip(*blocks, strict=True) if blocks else ((), ())
    columns = [[*none, *locals_], [*none, *contents], *[[*values, *[None] * len(blocks)] for values in own]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted in their task, get the number of distinct ones up to them."""
    rank, last, first = 0, None, None
    for batch in batches:
        blocks, names = batch.column(1), []
        if first is None and batch.num_rows:
            first = batch.column(8)[0].as_py() << 33
        for block in blocks.to_pylist():
            if block is not None and block != last:
                rank, last = rank + 1, block
            names.append(None if block is None else first + rank)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), *[batch.column(i) for i in range(2, 8)]], names=["local", "name", *[n for n, _ in _FIELDS[2:]]])


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(row, k, points, length, text_sha256, name) per row of ``docs``: its
    number, key, code points, bytes without white space, their SHA-256, and the
    integer that together with ``length`` is the identity of the text.

    White space is space, \\t \\n \\v \\f \\r; null texts count as empty (length
    and name 0). ``docs`` should be read from files, so that a task that runs
    again meets the same rows. Columns other than the two are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long"), F.col(text)).toDF("row", "k", "t")
    cut = rows.mapInArrow(_cut(block, held), CUT)
    # blocks by content; documents, which have none, by their number
    dealt = cut.repartition("block", F.when(F.col("block").isNull(), F.col("row"))).sortWithinPartitions("block", "local")
    named = written(dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_named, NAMED), "block-names")
    meta = named.where("local is null").select("row", "k", "points", "length", "text_sha256", "ids")
    names = named.where("local is not null").select("local", "name")

    steps = meta.select("row", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "local"))
    level = written(steps.join(names, "local").select("row", "pos", "name", "n"), "names-0")
    found, most, depth = level.where("n = 1").select("row", "name"), level.agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        depth += 1
        half = F.shiftright("pos", 1).alias("pos")
        pairs = level.where("n > 1").groupBy("row", half).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("r"),
            F.shiftright(F.max("n") + 1, 1).alias("n"),
        )
        pairs = written(pairs, f"pairs-{depth}")
        distinct = pairs.select("l", "r").distinct().sortWithinPartitions("l", "r")
        numbers = written(distinct.withColumn("name", F.monotonically_increasing_id() + 1), f"pair-names-{depth}")
        level = written(pairs.join(numbers, ["l", "r"]).select("row", "pos", "name", "n"), f"names-{depth}")
        found, most = found.union(level.where("n = 1").select("row", "name")), (most + 1) // 2
    return meta.drop("ids").join(found, "row", "left").withColumn("name", F.coalesce("name", F.lit(0)))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, held: int = HELD) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (see ``identities``).
    Of equal ones the row with the most code points stays, then the smallest
    key (null last); of rows that tie in both, one. ``keep_id`` is the key of
    the row that stays, so null where that has none. Null texts are equal to
    empty ones. An empty table gives an empty table.
    """
    told = written(identities(docs, key, text, block, held), "identities")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("k").isNull().alias("none"), "k", "row")).alias("best")
    # as a table of its own, so that the join deals both sides anew and AQE can split a hot identity
    groups = written(told.groupBy("length", "name").agg(F.count(F.lit(1)).alias("group_size"), best), "groups")
    out = told.join(groups, ["length", "name"])
    return out.select(F.col("k").alias(key), F.col("best.k").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
