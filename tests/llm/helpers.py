"""Small fixtures with every odd case of a documents table."""

from __future__ import annotations

import os

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use themselves
CLASHING = "score double, size long, copies int, k long, t string, row long, label string, shards string, sequence_id long, lang_pred string, component_id long"

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n ", "en", None),
    (5, "one two", "en", "a"),
    (6, "one two", "en", "a"),
    (6, "one two", "en", "a"),
    (None, "words without an id of their own here", "en", "b"),
    (None, None, None, None),
    (8, "!!! ### 123 456", "en", "b"),
    (9, "Der Hund läuft über die Straße und die Katze schläft auf dem Sofa", "de", "b"),
    (10, "long " * 30000 + "end", "en", "c"),
    (11, "é" * 5000, "fr", "c"),
    (12, "\x00 odd \x1c control \x85 marks \u2028 here <|endoftext|>", "en", "c"),
]


def odd_docs(spark, clashing: bool = False):
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in ODD], DOCS)
    if clashing:
        from pyspark.sql import functions as F

        for part in CLASHING.split(", "):
            name, kind = part.split(" ")
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def real_docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def same_rows(df, others):
    """Rows of a DataFrame as sorted tuples equal ``others``."""
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(others, key=key)
