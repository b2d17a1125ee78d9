"""Corpus pipeline over the training-data operators.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns what the next one reads. All but the last return the
columns of ``documents``. ``run`` applies them to a folder's documents, each
stage written as Parquet in the shared checkpoint folder and read again.

The models are fitted on the documents that reach their stage. Null and empty
texts have no language and go at the first stage; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinkframe.llm import langid, minhash, mixing, packing, quality
from thinkframe.llm.common import without, written
from thinkframe.llm.queries import END_OF_PIECE, MAX_TOKENS, table, vocabulary
from thinkframe.session import shared_path

LEAST_LANGUAGE_SCORE = 0.1  # below it the text is in none of the learned languages
LEAST_QUALITY = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language."""
    found = langid.identify(docs, langid.fit(docs), names=("__lang", "__sure"))
    return found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__sure") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the model holds for good (all, where no labels are)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, column="__quality")
    return scored.where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the row of the
    smallest doc_id (null last). Documents are rows of the table, numbered as
    its files are read, so rows that repeat an id are documents of their own."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    found = written(minhash.near_duplicates(numbered, key="__row", words=5, percent=80), "near-duplicates")
    groups = found.where("not kept").select("component_id").distinct()
    members = found.join(groups, "component_id", "left_semi").join(numbered.select("__row", F.col("doc_id").alias("__id")), "__row")
    members = written(members.select("component_id", F.struct(F.col("__id").isNull().alias("none"), "__id", "__row").alias("at")), "near-groups")
    stays = members.groupBy("component_id").agg(F.min("at").alias("at")).select("at.__row")
    goes = written(members.select("at.__row").join(stays, "__row", "left_anti"), "dropped-rows")
    return without(numbered, goes, "__row").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, shard by shard."""
    own = {c: f"__own_{c}" for c in docs.columns if c in (*mixing.ADDED, "shard")}
    mixed = mixing.mix(docs.withColumnsRenamed(own), weights=(1, 2, 3), share=1.0, ceiling=3)
    return mixing.drawn(mixed).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every copy with its sequence and place."""
    packed = packing.pack_documents(docs, vocabulary(), MAX_TOKENS, END_OF_PIECE, max_documents=MAX_TOKENS, max_attention=MAX_TOKENS * MAX_TOKENS)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None  # models, random draws and tokens are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
