"""Registered queries: SQL twins, column contracts, and the pipeline's stages."""


import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SF, no_docs, odd_docs
from tests.llm.test_packing import check
from thinkframe.llm.oracles import ORACLES
from thinkframe.llm.queries import QUERIES

COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op11_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_operator_has_its_query():
    assert set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    out = QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    for column in COLUMNS[name].split(", "):
        n, kind = column.split(" ")
        assert kinds[n] == kind
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in out.select(*columns).collect()))) == sorted(map(str, want))


def staged(spark, docs, upto):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:upto]):
        from thinkframe.session import shared_path

        path = shared_path(spark, f"test-stage-{i}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "near_dedup", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.language_id(spark, docs, SF).count() == docs.count()  # all have letters
    good = corpus_pipeline.quality_classifier(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = labels.where("quality = 1").join(docs, "doc_id").join(good, "doc_id", "left_anti").count()
    assert good.columns == docs.columns and lost <= 1
    from tests.llm.test_near_duplicates import brute

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = sorted(i for i, _, _, kept in brute(rows, 5, 80) if kept)
    single = corpus_pipeline.near_dedup(spark, good, SF)
    assert sorted(r["doc_id"] for r in single.collect()) == want
    mixed = corpus_pipeline.mix_sources(spark, single, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    check(packed, 1024, 1024, 1024 * 1024)
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("make", [no_docs, odd_docs])
def test_pipeline_on_odd_tables(spark, make):
    docs = make(spark) if make is no_docs else make(spark, clashing=True)
    out = staged(spark, docs, 4)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
    assert 2 not in ids and 3 not in ids
    assert corpus_pipeline.pack_sequences(spark, out, SF).count() >= 0
