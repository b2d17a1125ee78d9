"""Source mixing: targets, quotas and draws."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, ODD, SF, no_docs, odd_docs, real_docs
from thinkframe.llm import mixing
from thinkframe.llm.queries import QUERIES


def test_words_are_counted_as_the_contract_says(spark):
    rows = odd_docs(spark).select("text", mixing.word_count("text").alias("n")).collect()
    for r in rows:
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


def test_targets_stop_at_the_ceiling_and_reshare():
    out = mixing.reshared_targets([10, 100, 1000, 0], [3, 1, 1, 2], 1110, 3)
    assert out.tolist() == [30, 300, 780, 0]
    assert mixing.reshared_targets([5, 5], [1, 1], 10, 3).tolist() == [5, 5]
    assert mixing.reshared_targets([], [], 0, 3).tolist() == []
    assert mixing.reshared_targets([0, 0], [1, 2], 0, 3).tolist() == [0, 0]


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_quota_tree_hands_out_every_block_once(shards):
    quotas = np.array([5, 0, 1000, 63, 1])
    out = mixing.split_quotas(quotas, shards, np.random.Generator(np.random.PCG64(2)))
    assert out.sum(axis=1).tolist() == quotas.tolist() and (out >= 0).all()
    assert out.sum(axis=0).max() - out.sum(axis=0).min() <= np.ceil(np.log2(max(2, shards)))


def fitting(groups, left):
    """(hashes taken in hash order as they fit, words left)."""
    taken = []
    for h in sorted(groups):
        if 0 < groups[h] <= left:
            left -= groups[h]
            taken.append(h)
    return taken, left


def brute_copies(rows, hashes, ceiling=3):
    """Copies per row of (key, text, source): whole epochs, then every document
    in hash order that fits, then one document for others."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    targets = mixing.reshared_targets([total[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], sum(size), ceiling)
    copies = [0] * len(rows)
    for s, target in zip(names, targets, strict=True):
        own = [i for i, r in enumerate(rows) if r[2] == s]
        epochs = min(ceiling, int(target / total[s] + 1e-9)) if total[s] else 0
        rest = target - epochs * total[s] if epochs < ceiling else 0
        groups = Counter()
        for i in own:
            groups[hashes[i] % (1 << 64)] += size[i]
        taken, left = fitting(groups, rest) if rest >= 1 else ([], rest)
        out = {h: w for h, w in groups.items() if w and h not in taken}
        assert not taken or all(w > left for w in out.values())
        if taken and out and left > target / 1000:
            w, h = min((w, h) for h, w in out.items())
            gone, over = fitting({x: groups[x] for x in taken}, w - left)
            if over < left:
                taken = [x for x in taken if x not in gone] + [h]
        for i in own:
            copies[i] = epochs + (hashes[i] % (1 << 64) in taken)
    return copies


def checked(spark, rows):
    df = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], DOCS)
    hashes = df.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "text")).collect()
    assert [(r["doc_id"], r["text"], r["source"]) for r in hashes] == rows
    want = Counter(zip([(r[0], r[2], r[1]) for r in rows], brute_copies(rows, [r["h"] for r in hashes]), strict=True))
    got = Counter(((r["doc_id"], r["source"], r["text"]), r["copies"]) for r in mixing.mix(df).collect())
    assert got == want
    return df


def test_copies_of_real_documents_against_brute_force(spark):
    checked(spark, [(r["doc_id"], r["text"], r["source"]) for r in real_docs(spark).collect()])


def test_a_long_document_costs_no_source_its_target(spark, monkeypatch):
    """One text as long as all others of its source, small blocks, a source
    without words, repeated rows."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, "w " * 100, "a") for i in range(700)] + [(10_000, "v " * 70_000, "a")]
    rows += [(20_000 + i, "x " * (i % 37), "b") for i in range(900)] + [(30_000, "  ", "c"), (30_001, None, "c")]
    rows += [(40_000 + i // 4, "same words here", None) for i in range(80)]
    df = checked(spark, rows)
    words, target = Counter(), {}
    for r in mixing.mix(df).collect():
        words[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert abs(target["a"] - words["a"]) < 100 and abs(target["b"] - words["b"]) < 2 and abs(target[None] - words[None]) < 12


def test_query_counts_the_drawn_words(spark):
    out = QUERIES["op3_mix_sources"](spark, SF).collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in real_docs(spark).collect()]
    hashes = real_docs(spark).select(F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()
    want = {i: n for (i, _, _), n in zip(rows, brute_copies(rows, [r["h"] for r in hashes]), strict=True)}
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["size"] * want[r["doc_id"]] for r in out} and len(out) == len(want)


def test_reruns_and_partitionings_agree(spark):
    a = sorted(map(tuple, mixing.mix(real_docs(spark)).select("doc_id", "copies", "shards").collect()))
    b = sorted(map(tuple, mixing.mix(real_docs(spark).repartition(7)).select("doc_id", "copies", "shards").collect()))
    assert a == b


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_draws_are_disjoint_blocks_of_the_shards_quota(spark, monkeypatch, shards):
    """Each (source, epoch, block) lies in one shard, and a shard holds its quota of them."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    handed = []
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: handed.append(split(*a)) or handed[-1])
    docs = real_docs(spark)
    mixed = mixing.mix(docs, shards=shards)
    drawn = mixing.drawn(mixed)
    assert drawn.rdd.getNumPartitions() == shards
    assert drawn.count() == mixed.agg(F.sum("copies")).first()[0] and "shard" in drawn.columns
    n = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    names = sorted(n, key=lambda s: (s is None, s))
    bits = {s: max(0, int(np.ceil(np.log2(n[s] / 4)))) for s in names}
    places = {}
    for r in mixed.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "text")).collect():
        for epoch, shard in enumerate(r["shards"]):
            block = (r["h"] % (1 << 64)) >> (64 - bits[r["source"]])
            places.setdefault((r["source"], epoch, block), set()).add(shard)
    assert all(len(x) == 1 for x in places.values())
    most = handed[0]
    for i, s in enumerate(names):
        used = Counter(next(iter(x)) for (own, epoch, _), x in places.items() if own == s)
        whole = sum(most[i])
        assert len([k for k in places if k[0] == s]) >= 0.5 * whole
        last = max(k[1] for k in places if k[0] == s)
        full = Counter(next(iter(x)) for (own, epoch, _), x in places.items() if own == s and epoch < last)
        assert all(full[j] <= most[i][j] for j in range(shards)) and set(used) <= {j for j in range(shards) if most[i][j]}


def test_shards_follow_the_words(spark, monkeypatch):
    assert mixing.mix(real_docs(spark)).schema["shards"].metadata["count"] == 1
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    mixed = mixing.mix(real_docs(spark))
    words = real_docs(spark).agg(F.sum(mixing.word_count("text"))).first()[0]
    assert mixed.schema["shards"].metadata["count"] == -(-words // 2000)
    monkeypatch.setattr(mixing, "MOST_SHARDS", 7)
    assert mixing.mix(real_docs(spark)).schema["shards"].metadata["count"] == 7


def test_odd_rows(spark):
    docs = odd_docs(spark, clashing=True)
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(ODD) and set(out.columns) == set(docs.columns) | {"size", "source_size", "target", "copies", "shards"}
    by = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert by[None][0] == 0 and by[None][1] == 0  # null source: last, only texts without words
    assert sum(t for _, t in by.values()) == pytest.approx(sum(s for s, _ in by.values()))


def test_no_documents(spark):
    assert mixing.mix(no_docs(spark)).count() == 0
