"""Hash-prefix forest: recall and exact scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF
from tests.llm.test_near_duplicates import ODD_VECTORS, cloud
from thinkframe.llm import ann
from thinkframe.llm.vectors import cosine


def brute(rows, is_query, k):
    good = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            good.setdefault(i, np.array(x, np.float64))
    out = {}
    for q in filter(is_query, good):
        scores = [(-(good[q] @ v) / (np.linalg.norm(good[q]) * np.linalg.norm(v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: near for q, near in out.items() if near}


def found(df, condition, k):
    out, report = ann.nearest(df, condition, k)
    by = {}
    for r in out.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(by[r["query_id"]])
    return by, report


def recall(got, want):
    return np.mean([i in dict(got[q]) for q, near in want.items() for i, _ in near])


@pytest.mark.parametrize("group", [32_768, 100])
def test_recall_on_the_embeddings(spark, monkeypatch, group):
    monkeypatch.setattr(ann, "GROUP_ROWS", group)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, lambda i: i % 10 == 0, 5)
    got, report = found(df, F.col("vec_id") % 10 == 0, 5)
    assert set(got) == set(want) and recall(got, want) >= 0.9 and report["recall"] >= 0.9
    vectors = {i: np.array(x, np.float64) for i, x in rows}
    for q, near in got.items():
        assert len(near) == 5 and [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for i, s in near:
            assert s == pytest.approx(vectors[q] @ vectors[i] / (np.linalg.norm(vectors[q]) * np.linalg.norm(vectors[i])), abs=1e-12)


def test_copies_and_ties_go_to_the_smaller_key(spark):
    rows = cloud(3, 120, 6, 0.2) + [(500 + i, [1.0] + [0.0] * 7) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, _ = found(df, F.col("vec_id") % 5 == 0, 5)
    assert [i for i, _ in got[505]] == [500, 501, 502, 503, 504]
    assert [i for i, _ in got[500]] == [501, 502, 503, 504, 505]
    assert recall(got, brute(rows, lambda i: i % 5 == 0, 5)) >= 0.9


def test_thousands_of_rescaled_copies(spark):
    """Cosines that differ in their last bits: the ids are those of the exact ranking."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base * rng.uniform(0.1, 9)]) for i in range(4000)] + [(5000 + i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, _ = found(df, F.col("vec_id") % 50 == 0, 5)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in range(0, 4000, 50):
        score = cosine(x, np.broadcast_to(x[q], x.shape))
        score[q] = -2
        assert got[q] == [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score))[:5]]


def test_vectors_of_each_length_meet_their_own(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(x) for x in rng.normal(size=(8, 32, 5)[i % 3])]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, _ = found(df, F.col("vec_id") % 7 == 0, 4)
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 7 == 0, 4)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_odd_vectors(spark):
    df = spark.createDataFrame([(i, x, "", 0) for i, x in ODD_VECTORS], "vec_id long, embedding array<double>, v string, code long")
    got, _ = found(df, F.lit(True), 5)
    want = brute(ODD_VECTORS, lambda i: True, 5)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_no_vectors_and_no_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert found(none, F.lit(True), 5)[0] == {}
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert found(some, F.lit(False), 5)[0] == {}
    assert found(some, F.lit(True), 5)[0] == {}
