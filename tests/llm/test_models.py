"""Quality and language models: held-out accuracy, the FM identity, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, no_docs, odd_docs
from thinkframe.llm import langid, quality
from thinkframe.llm.sampling import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_fold_is_the_unsigned_crc32_of_the_text(spark):
    import zlib

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_linear_time_score_equals_all_pairs():
    rng = np.random.Generator(np.random.PCG64(1))
    model = {"w0": 0.3, "w": rng.normal(size=quality.SIZE), "v": rng.normal(size=(quality.SIZE, quality.FACTORS))}
    ids, stats = rng.integers(0, quality.WORDS, 7), rng.integers(quality.WORDS, quality.SIZE, (1, 5))
    features = [(i, 1 / 7) for i in ids] + [(i, 1.0) for i in stats[0]]
    want = model["w0"] + sum(model["w"][i] * x for i, x in features)
    want += sum((model["v"][a] @ model["v"][b]) * x * y for n, (a, x) in enumerate(features) for b, y in features[n + 1 :])
    got = quality.raw_scores(model, ids, np.array([0, 7]), stats)
    assert got[0] == pytest.approx(want)


def test_quality_on_held_out_documents(spark, docs, labels):
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id"), 5) == 0).select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert good and bad and np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in rows]) > 0.93


def test_quality_does_not_see_labels_of_held_out_documents_or_other_columns(spark, docs, labels):
    changed = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = quality.score(docs, quality.fit(docs, labels)).select("doc_id", "score")
    b = quality.score(other, quality.fit(other, changed)).select("doc_id", "score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_quality_of_odd_rows(spark, docs, labels):
    model = quality.fit(docs, labels)
    odd = odd_docs(spark, clashing=True)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert quality.score(no_docs(spark), model).count() == 0
    assert quality.fit(no_docs(spark), labels) is None and quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}


def test_language_on_held_out_documents(spark, docs):
    rows = langid.identify(docs, langid.fit(docs)).where(fold(F.col("doc_id"), 4) == 2).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_families_first_then_pairs():
    rng = np.random.Generator(np.random.PCG64(2))
    centre = {"fr": [3, 0, 1, 0], "es": [3, 0, 0, 1], "de": [0, 3, 1, 0], "en": [0, 3, 0, 1], "xx": [-3, -3, 0, 0]}
    langs = [a for a in centre for _ in range(40)]
    x = np.array([centre[a] + 0.2 * rng.normal(size=4) for a in langs], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.train(x, langs)
    assert model["families"] == 3 and len(model["pairs"]) == 2
    best, score = langid.predict(model, x)
    assert [model["langs"][i] for i in best] == langs and (score > 0.4).all()


def test_language_of_odd_rows(spark, docs):
    model = langid.fit(docs)
    rows = langid.identify(odd_docs(spark, clashing=True), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or r["score"] == 0)
    assert langid.identify(no_docs(spark), model).count() == 0
    assert langid.fit(no_docs(spark)) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs(spark), None).collect()} == {"und"}


def test_one_language_only(spark, docs):
    model = langid.fit(docs.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang = 'fr'"), model).collect()} == {"fr"}
