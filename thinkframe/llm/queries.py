"""The registered queries of the training-data operators.

Each applies its operator with production parameters to its whole table and
derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinkframe.llm import ann, chat, codebooks, langid, licenses, minhash, mixing, naming, packing, quality, spelling, tokenfile, vecdedup
from thinkframe.llm.common import written
from thinkframe.llm.sampling import fold
from thinkframe.session import shared_path

MAX_TOKENS = 1024
END_OF_PIECE = 2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(
        table(spark, sf_dir, "documents"), vocabulary(), MAX_TOKENS, END_OF_PIECE,
        max_documents=MAX_TOKENS, max_attention=MAX_TOKENS * MAX_TOKENS,
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, ceiling=3)
    count = mixed.schema["shards"].metadata  # a document's number counts its copies among the drawn rows
    rows = mixed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "size", "source_size", "target", "copies", F.col("shards").alias("shards", metadata=count))
    rows = written(rows, "mixed")
    drawn = written(mixing.drawn(rows.select("row", "doc_id", "size", "copies", F.col("shards").alias("shards", metadata=count))), "drawn")
    taken = drawn.groupBy("row").agg(F.sum("size").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)[0]


def _held_out(of: int, remainder: int):
    return F.coalesce(fold(F.col("doc_id"), of) == remainder, F.lit(False)).alias("held_out")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out=(5, 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, held_out=(4, 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).alias("conv_id"),
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit(probe).alias("content")) for r in ("user", "assistant")]).alias("messages"),
    )
    segments = written(chat.formatted(turns.union(chat.canonical_turns(extra))), "formatted-chats")
    return chat.digests(chat.parsed(segments))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=0)
    return tokenfile.token_positions(spark, path)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)[0]


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least_length=7, least_count=2, times=10, one_in=31)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books, _ = codebooks.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return codes.withColumn("codebooks_sha256", F.lit(books.sha256()))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_mix_sources": op3_mix_sources,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_id": op6_language_id,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_token_files": op8_token_files,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
}
