"""Training-array encoding.

Byte-level token ids (each UTF-8 byte + 2; pad 0, eos 1), response-only
labels (-100 over the prompt span), attention mask, truncation, and
right-padding within batches. Everything is array expressions on the row;
batches are formed inside hash buckets so no single task numbers all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.functions.text import col
from thinkframe.operators.ordering import seeded_hash
from thinkframe.session import written

# Fixed values of the byte tokenizer.
PAD_ID = 0
EOS_ID = 1
BYTE_OFFSET = 2
EOS_TEXT = "\x01"
IGNORE_INDEX = -100


def ensure_eos(response, eos: str = EOS_TEXT) -> Column:
    """Append the end-of-sequence text unless the response ends with it."""
    r = col(response)
    return F.when(r.endswith(eos), r).otherwise(F.concat(r, F.lit(eos)))


def byte_ids(text, most: int | None = None) -> Column:
    """UTF-8 bytes of the text (the first ``most``), each + 2, as array<int>
    (empty text -> []).

    Decoding the UTF-8 bytes as ISO-8859-1 maps every byte to one character
    whose code point is the byte value, so ``ascii`` of each character is
    the byte.
    """
    return _ids(_utf8(text, most))


def _utf8(text, most: int | None) -> Column:
    raw = F.encode(col(text), "UTF-8")
    return F.substring(raw, 1, most) if most else raw


def _ids(raw: Column) -> Column:
    ids = F.transform(F.split(F.decode(raw, "ISO-8859-1"), ""), lambda c: F.ascii(c) + BYTE_OFFSET)
    return F.when(F.octet_length(raw) == 0, F.array().cast("array<int>")).otherwise(ids)


def encode_examples(
    rows: DataFrame,
    prompt: str = "prompt",
    response: str = "response",
    max_seq_len: int = 2048,
    eos: str = EOS_TEXT,
) -> DataFrame:
    """input_ids = (prompt ids + response ids)[:max]; labels mask the prompt span.

    Prompt and response are put together and cut as bytes; what is left becomes
    ids once.
    """
    both = F.concat(_utf8(F.col(prompt), max_seq_len), _utf8(ensure_eos(F.col(response), eos), max_seq_len))
    staged = rows.withColumn("input_ids", _ids(F.substring(both, 1, max_seq_len)))
    n_ids = F.size("input_ids")
    n_mask = F.least(F.octet_length(F.col(prompt)), n_ids)
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE_INDEX), n_mask),
        F.slice("input_ids", n_mask + 1, F.greatest(n_ids - n_mask, F.lit(0))),
    )
    return staged.withColumn("labels", labels).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), n_ids)
    )


def encoded_length(prompt: str = "prompt", response: str = "response", max_seq_len: int = 2048, eos: str = EOS_TEXT) -> Column:
    """Number of ids ``encode_examples`` gives, from byte lengths alone."""
    n = F.octet_length(F.col(prompt)) + F.octet_length(ensure_eos(F.col(response), eos))
    return F.least(n, F.lit(max_seq_len))


def assign_batches(rows: DataFrame, key: str, length: Column, batch_size: int = 4, bucket_rows: int = 16_384,
                   seed: int = 17, home: str | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with ``bucket``, ``batch_no`` and ``width`` (the batch's longest ``length``).

    Batches are consecutive runs of ``batch_size`` in seeded order within hash
    buckets of about ``bucket_rows`` rows; their number follows the table, so
    the batches are the same on any cluster. Numbering and widths use narrow
    (key, hash, length) rows; they are joined back by ``key`` (unique) before
    anything is encoded. ``home`` and ``parts`` (see ``distill.sft_rows``): they
    are sent to the rows, which then stay where they lie.
    """
    own = [F.col(home).alias("_home")] if home else []
    narrow = written(rows.select(F.col(key).alias("_k"), seeded_hash(seed, F.col(key)).alias("_h"), length.alias("_n"), *own), "batch-keys")
    buckets = max(1, -(-narrow.count() // bucket_rows))
    bucket = F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("_h"))
    placed = narrow.withColumn("bucket", bucket).withColumn("batch_no", F.floor((place - 1) / batch_size).cast("int"))
    width = F.max("_n").over(Window.partitionBy("bucket", "batch_no"))
    placed = placed.select("_k", "bucket", "batch_no", width.cast("int").alias("width"), *(["_home"] if home else []))
    if home is None:
        return rows.join(placed, F.col(key) == F.col("_k")).drop("_k")
    placed = placed.repartition(parts, "_home").groupBy("_home").agg(F.collect_list(F.struct("_k", "bucket", "batch_no", "width")).alias("_placed"))
    found = rows.join(placed.hint("shuffle_hash"), F.col(home) == F.col("_home"))
    own_place = F.filter("_placed", lambda p: p["_k"] == F.col(key))
    return found.select(*rows.columns, F.inline(own_place)).drop("_k")


def pad_batches(encoded: DataFrame) -> DataFrame:
    """Right-pad each row to its batch's ``width``: ids with 0, labels -100, mask 0."""
    n = F.col("width") - F.size("input_ids")
    return encoded.select(
        *[c for c in encoded.columns if c not in ("input_ids", "labels", "attention_mask")],
        F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), n)).alias("input_ids"),
        F.concat("labels", F.array_repeat(F.lit(IGNORE_INDEX), n)).alias("labels"),
        F.concat("attention_mask", F.array_repeat(F.lit(0), n)).alias("attention_mask"),
    )


def supervised_ratio(padded: DataFrame, by=()) -> DataFrame:
    """Label cells that are not -100 over all label cells (padding included)."""
    sup = F.size(F.filter("labels", lambda x: x != IGNORE_INDEX))
    return padded.groupBy(*by).agg(
        F.sum(sup).alias("supervised"), F.sum(F.size("labels")).alias("cells")
    ).withColumn("ratio", F.col("supervised") / F.greatest(F.col("cells"), F.lit(1)))


def batch_sample(rows: DataFrame, key: str, k: int, seed: int = 17) -> DataFrame:
    """L4: ``k`` rows in seeded hash order (a repeatable random sample)."""
    return rows.withColumn("_h", seeded_hash(seed, F.col(key))).orderBy("_h").limit(k).drop("_h")
