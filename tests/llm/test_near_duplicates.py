"""Near duplicates of texts and of vectors, components: against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import ODD, no_docs, odd_docs, real_docs
from thinkframe.llm import common, minhash, vecdedup
from thinkframe.llm.components import connected_components


def components(nodes, links):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return comp


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    comp = components({i for i, _ in rows if i is not None}, links)
    return sorted(((i, len(s), comp.get(i), i == comp.get(i)) for i, s in sets), key=str)


def found(df, **how):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **how).collect()), key=str)


@pytest.mark.parametrize("words", [4, 5])
def test_real_documents(spark, words):
    rows = [(r["doc_id"], r["text"]) for r in real_docs(spark).collect()]
    assert found(real_docs(spark), words=words, percent=80) == brute(rows, words, 80)


def test_odd_rows(spark):
    assert found(odd_docs(spark, clashing=True), words=4) == brute([(i, t) for i, t, _, _ in ODD], 4, 80)


def test_no_documents(spark):
    assert found(no_docs(spark)) == []


def test_rows_that_repeat_an_id_are_one_node(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    rows = [(1, a), (2, b), (2, a), (3, c), (4, b), (5, None), (5, c), (6, d), (6, ""), (7, d), (None, a), (9, "only"), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 80)
    assert {r[2] for r in want if r[0] in (1, 2, 4)} == {1} and {r[2] for r in want if r[0] in (3, 5)} == {3}
    assert found(df, words=4) == want
    assert found(df.repartition(5), words=4) == want


def test_pipeline_keeps_one_row_of_each_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (3, c), (4, b), (None, c), (None, a + " " + b), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(out, key=str) == sorted([(1, a), (2, b), (3, c), (None, a + " " + b), (5, None), (5, None)], key=str)


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_rows_without_some_keys(spark, monkeypatch, bits):
    """With few keys most rows stay in place; with all bits set it is an anti-join."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    df = spark.range(5000).select((F.col("id") - 100).alias("k"), F.lit("t").alias("t"))
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    assert sorted(r["k"] for r in common.without(df, keys, "k").collect()) == [i for i in range(-100, 4900) if i < 0 or i % 7]
    assert common.without(df, keys.limit(0), "k").count() == 5000


def copies(seed, n, words, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append((i, " ".join(own)))
    rng.shuffle(out)
    return [(i, t) for i, (_, t) in enumerate(out)]


@pytest.mark.parametrize("listed,block", [(4, 2048), (0, 2048), (0, 16)])
def test_groups_whose_members_are_not_all_alike(spark, monkeypatch, listed, block):
    """Copies at 0.5 to 1: components need links across stars, by lists, by
    forests and by blocks of large keys."""
    monkeypatch.setattr(minhash, "LISTED", listed)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = copies(1, 60, 100, 9) + [(100 + i, t) for i, t in copies(2, 30, 40, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, words=4, percent=80) == brute(rows, 4, 80)


@pytest.mark.parametrize("rounds", [0, 1])
def test_keys_that_stay_open_are_compared_exactly(spark, monkeypatch, rounds):
    """Long texts just under the threshold pass signatures and bitmaps; with
    forests only, more rounds than these would be needed."""
    monkeypatch.setattr(minhash, "MAX_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "LISTED", 0)
    rng = np.random.Generator(np.random.PCG64(8))
    base = [f"w{i}" for i in range(6000)]
    rows = []
    for i in range(24):
        own = list(base)
        own[: 900] = [f"x{i - i % 8 if i % 8 < 2 else i}y{j}" for j in range(900)]  # pairs (0, 1), (8, 9) ... are alike
        own[int(rng.integers(1000, 5000))] = f"z{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 80)
    assert sum(not w[3] for w in want) == 3
    assert found(df, words=4, percent=80) == want


def test_bitmaps_never_exclude_a_link():
    rng = np.random.Generator(np.random.PCG64(4))
    sets = []
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (1, 3, 30, 400, 4000):
        for drop in (0, 0.05, 0.1, 0.2):
            own = base[:n][rng.random(n) >= drop]
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 63, int(n * drop), dtype=np.uint64)])))
    sizes, maps = np.array([len(s) for s in sets]), [np.frombuffer(minhash.bitmap(s.tobytes()), np.uint64) for s in sets]
    p, q = np.triu_indices(len(sets), 1)
    good = minhash.possible(sizes, maps, p, q, 80)
    for a, b, g in zip(p, q, good, strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        if sizes[a] and sizes[b] and 100 * both >= 80 * (sizes[a] + sizes[b] - both):
            assert g


def test_estimates_are_near_the_similarity(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    minima, x = minhash._Minima(), rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for share in (0.3, 0.5, 0.8, 0.95):
        keep = int(900 * 2 * share / (1 + share))
        y = np.concatenate([x[:keep], rng.integers(0, 1 << 63, 900 - keep, dtype=np.uint64)])
        a, b = (minhash.packed(minima.of(v)[None])[0] for v in (x, y))
        row = spark.createDataFrame([tuple(int(v) for v in (*a, *b))], ", ".join(f"{s}{i} long" for s in "lr" for i in range(minhash.LONGS)))
        from pyspark.sql import functions as F

        row = row.select(*[F.struct(*[F.col(f"{s}{i}").alias(f"s{i}") for i in range(minhash.LONGS)]).alias(s) for s in "lr"])
        got = row.select(minhash.estimate(minhash.equal_lanes("l", "r")).alias("e")).first()["e"]
        assert abs(got - share) < 0.2


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3), (5, None)], "a long, b long")).collect()}
    want = components({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, v string, rep long")


def brute_vectors(rows, least):
    first = {}
    for i, x in rows:
        first.setdefault(i, x)
    good = {i: np.array(x, np.float64) for i, x in first.items() if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x) and len(x) == 8}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= least]
    comp = components({i for i in first if i is not None}, links)
    return sorted(((i, sum(i in p for p in links), comp.get(i), i == comp.get(i)) for i in first), key=str)


def cloud(seed, n, groups, spread):
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.normal(size=(groups, 8))
    return [(i, (centres[i % groups] + spread * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [8192, 40])
def test_vector_links_in_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(vecdedup, "BLOCK", block)
    rows = cloud(1, 300, 12, 0.25) + [(1000 + i, [1.0, 2.0] + [0.0] * 6) for i in range(30)]
    out, report = vecdedup.near_duplicates(vectors(spark, [(*r, 0, "", 0) for r in rows]), least=0.9)
    assert report["recall"] >= 0.99
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = brute_vectors(rows, 0.9)
    assert [g[0] for g in got] == [w[0] for w in want]
    if block == 8192:
        assert got == want
    else:
        assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)


def test_shards_overlap(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "SHARD", 40)
    rows = cloud(2, 400, 100, 0.05)
    out, report = vecdedup.near_duplicates(vectors(spark, [(*r, 0, "", 0) for r in rows]), least=0.9)
    assert report["recall"] >= 0.99
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_vectors(rows, 0.9)


def test_pairs_beside_a_hot_group(spark, monkeypatch):
    """Lost small pairs show in the audit although one group has nearly all links."""
    monkeypatch.setattr(vecdedup, "SHARD", 40)
    monkeypatch.setattr(vecdedup, "OVERLAP", 1)
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.normal(size=(200, 8))
    y = x + 0.3 * rng.normal(size=x.shape)
    hot = np.ones(8) + 0.01 * rng.normal(size=(500, 8))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([x, y, hot]))]
    out, report = vecdedup.near_duplicates(vectors(spark, [(*r, 0, "", 0) for r in rows]), least=0.9)
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    want = {w[0]: w[1] for w in brute_vectors(rows, 0.9)}
    small = [i for i in want if 0 < want[i] < vecdedup.FEW]
    assert len(small) > 100 and report["recall"] >= 0.99
    assert sum(got[i] for i in small) >= 0.98 * sum(want[i] for i in small) and all(got[i] <= want[i] for i in want)


def test_a_link_seen_from_one_end_counts_for_both(spark, monkeypatch):
    """Each end joins its own two shards; counts are those of pairs compared in either home, once."""
    monkeypatch.setattr(vecdedup, "SHARD", 40)
    rows = cloud(2, 400, 100, 0.15)
    classes = spark.createDataFrame([(i, 1, bytes(np.array(v, "<f4").tobytes())) for i, v in rows], "rep long, weight long, v binary")
    centroids = vecdedup._centroids(classes, 10, "<f4")
    got = {r["rep"]: r["n"] for r in vecdedup._links(classes, centroids, 2, 0.9, "<f4").groupBy("rep").agg({"links": "sum"}).toDF("rep", "n").collect()}
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = np.argsort(-(x.astype(np.float32) @ centroids.T), axis=1, kind="stable")[:, :2]
    meets = (top[:, None, :] == top[None, :, :1]).any(axis=2)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    want = (near & (meets | meets.T)).sum(axis=1)
    assert (near & (meets ^ meets.T)).any()
    assert [got.get(i, 0) for i in range(len(rows))] == want.tolist()


def test_no_links_in_the_audit_are_unknown():
    assert vecdedup.audit_recall({}, {}) is None
    assert vecdedup.audit_recall({1: 1, 2: 1, 3: 5000}, {1: 1, 3: 5000}) == 0.5


ODD_VECTORS = [
    (1, [1.0] * 8), (2, [2.0] * 8), (3, None), (4, []), (5, [0.0] * 8), (6, [1.0, None] + [0.0] * 6), (7, [float("nan")] + [1.0] * 7),
    (8, [float("inf")] + [1.0] * 7), (9, [1.0] * 8), (9, [1.0] * 8), (None, [1.0] * 8), (11, [1.0, 2.0]), (12, [-1.0] * 8), (13, [1e-30] * 8),
]


def test_odd_vectors(spark):
    out, _ = vecdedup.near_duplicates(vectors(spark, [(*r, 0, "", 0) for r in ODD_VECTORS], "double"), least=0.9)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_vectors(ODD_VECTORS, 0.9)


def test_vectors_of_each_length_link_among_themselves(spark):
    rng = np.random.default_rng(14)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(3)] + [(10, [1.0] * 32), (11, [3.0] * 32), (12, [0.5] * 31 + [0.4]), (20, [1.0] * 64), (21, [2.0] * 64), (30, [1.0])]
    out, _ = vecdedup.near_duplicates(vectors(spark, [(*r, 0, "", 0) for r in rows], "double"), least=0.9)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 10: (2, 10), 11: (2, 10), 12: (2, 10), 20: (1, 20), 21: (1, 20), 30: (0, 30)}


def test_no_vectors(spark):
    out, _ = vecdedup.near_duplicates(vectors(spark, []), least=0.9)
    assert out.collect() == []
