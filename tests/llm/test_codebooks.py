"""Vector codes against brute force, and the bounds that spare scans."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, same_rows
from thinkframe.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) and codebooks, entry by entry."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    size = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * size - len(v)), lab) for i, v, lab in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[p * size : (p + 1) * size] for _, v, _ in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[nearest(p, v[p * size : (p + 1) * size])[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * size : (p + 1) * size] for (_, v, _), c in zip(kept, chosen, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, totals = [], {}
    for i, v, lab in kept:
        found = [nearest(p, v[p * size : (p + 1) * size]) for p in range(parts)]
        error = sum(d for d, _ in found)
        totals[lab] = totals.get(lab, 0) + error
        out.append([i, "".join(f"{e:02x}" for _, e in found), error, lab])
    return [(i, c, e, totals[lab]) for i, c, e, lab in out], hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def checked(spark, rows, parts=4, entries=8, rounds=2, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    out, books, scans = codebooks.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, sha = brute(rows, parts, entries, rounds)
    same_rows(out.select("vec_id", "code", "error", "label_error"), want)
    assert books.sha256() == sha
    return scans


@pytest.mark.parametrize("rounds", [0, 1, 2, 6])
def test_random_vectors(spark, rounds):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 12)], int(rng.integers(0, 3))) for i in rng.permutation(300)]
    checked(spark, rows, rounds=rounds)


def test_clusters_spare_scans(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (8, 8))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.01, 8)], None) for i in range(400)]
    scans = checked(spark, rows, rounds=3)
    assert scans[0] == 4 * 400 and all(s < 0.1 * 4 * 400 for s in scans[1:])


def test_net_displacement_is_tighter_than_drift():
    """An entry that goes and comes back has not moved."""
    away, home = [[0, 0], [90, 0]], [[0, 0], [40, 0]]
    history = np.array([home, away, home])
    far, first, second = codebooks.net_displacements(history)
    assert first[0] == 0 and second[0] == 0 and first[1] == 50 and far[1] == 1
    x = np.array([[1, 0], [2, 1]])
    code, own, other = codebooks.scan(x, history[0])
    *_, again = codebooks.reassigned(x, history, code, other, np.zeros(2, np.uint8))
    assert again == 0  # accumulated drift, 100, would exceed the bound of 39


def test_bounds_never_change_a_result():
    rng = np.random.default_rng(8)
    for _ in range(40):
        history = rng.integers(-30, 30, (1, 9, 3))
        x = rng.integers(-30, 30, (200, 3))
        code, _, lower = codebooks.scan(x, history[0])
        stamp = np.zeros(200, np.uint8)
        for _ in range(5):
            history = np.concatenate([history, history[-1:] + rng.integers(-3, 4, (1, 9, 3))])
            code, own, lower, stamp, _ = codebooks.reassigned(x, history, code, lower, stamp)
            want = codebooks.scan(x, history[-1])
            assert (code == want[0]).all() and (own == want[1]).all()


def test_distances_are_exact_beyond_doubles():
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 5]], np.int64)
    entries = np.array([[-(1 << 26), 1 << 26], [(1 << 26), -(1 << 26) + 1]], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in entries] for r in x]
    assert codebooks.squared_distances(x, entries).tolist() == want


ODD = [
    (1, [0.5, -0.25, 1.0, 0.003], 1),
    (2, None, 1),
    (3, [0.5, None, 1.0, 0.0], 2),
    (4, [float("nan"), 0.0, 0.0, 0.0], None),
    (5, [float("inf"), 0.0, 0.0, 0.0], None),
    (6, [0.0, 0.0, 0.0, 0.0], None),
    (6, [0.5, -0.25, 1.0, 0.003], None),
    (6, [0.5, -0.25, 1.0, 0.003], None),
    (None, [-0.001, 0.001, -1e-9, 3.7], 2),
    (7, [0.25], 3),
    (8, [], 3),
    (9, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 4),
    (10, [1000.0, -1000.0, 0.0, 0.5], 4),
]


def test_odd_vectors(spark):
    checked(spark, ODD, entries=3)
    checked(spark, ODD, entries=64, parts=2)
    checked(spark, ODD[1:5], entries=4)
    checked(spark, [(8, [], 3), (9, [], 3)], entries=4)


def test_clashing_columns_and_floats(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    for name in ("code", "error", "label_error", "k", "v", "x", "cell"):
        df = df.withColumn(name, F.lit("clash"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in ODD]
    out, _, _ = codebooks.compress(df, parts=4, entries=5)
    same_rows(out.select("vec_id", "code", "error", "label_error"), brute(rows, 4, 5, 2)[0])


def test_empty_table(spark):
    out, books, scans = codebooks.compress(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["vec_id", "code", "error", "label_error"] and out.count() == 0
    assert scans == [] and books.sha256() == hashlib.sha256(b"").hexdigest()


def test_real_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"] and [float(x) for x in r["embedding"]], r["label"]) for r in df.collect()]
    out, books, _ = codebooks.compress(df)
    want, sha = brute(rows, 16, 64, 2)
    same_rows(out, want)
    assert books.sha256() == sha
