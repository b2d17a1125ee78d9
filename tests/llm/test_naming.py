"""Exact duplicates by block naming, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import DOCS, no_docs, odd_docs, real_docs, same_rows
from thinkframe.llm import naming


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha256); ties of kept in given order."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, n))
    out = []
    for norm, own in groups.items():
        best = min(own)
        for x in own:
            i, keep = rows[x[3]][0], rows[best[3]][0]
            out.append((i, keep, len(own), x == best, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def checked(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    same_rows(naming.exact_duplicates(docs, **how), brute(rows))


def test_real_documents(spark):
    docs = real_docs(spark)
    same_rows(naming.exact_duplicates(docs), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_documents(spark, clashing):
    docs = odd_docs(spark, clashing)
    same_rows(naming.exact_duplicates(docs), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_empty_table(spark):
    out = naming.exact_duplicates(no_docs(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_texts_that_differ_in_one_block_of_many(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abé ") for _ in range(700))
    rows = [(0, base), (1, base), (2, base.replace(" ", "\t\n"))]
    for i in range(60):
        at = rng.randrange(len(base))
        rows.append((3 + i, base[:at] + rng.choice("xyz") + base[at + 1 :]))
    rows += [(100, base[:-1]), (101, base + "a"), (102, base[350:] + base[:350])]
    checked(spark, rows, block=8, held=200)  # blocks forgotten and sent again
    checked(spark, rows, block=1 << 20)


def test_lengths_about_powers_of_two(spark):
    rows = [(n * 2 + c, "ab"[c] * n) for n in range(34) for c in (0, 1)] + [(500 + n, "a" * n) for n in (0, 1, 7, 8, 9, 16, 33)]
    checked(spark, rows, block=1)
    checked(spark, rows, block=4)


def test_most_code_points_then_smallest_id_stays(spark):
    rows = [(9, "a b"), (4, "ab"), (3, "a  b"), (7, "a\t\tb"), (None, "a\n\nb"), (3, "a  b"), (5, "ab "), (None, "x"), (None, " x ")]
    checked(spark, rows)


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, "same text " * 40 if i % 3 else f"text {i % 50} " * 30) for i in range(600)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    for n in (1, 7):
        same_rows(naming.exact_duplicates(docs.repartition(n), block=64, held=500), brute(rows))


def test_identity_is_free_of_collisions(spark):
    """One identity per content and one content per identity."""
    docs = real_docs(spark)
    told = naming.identities(docs, block=16).select("length", "name", "text_sha256").collect()
    assert len({(r[0], r[1]) for r in told}) == len({r[2] for r in told}) == len({tuple(r) for r in told})
    assert Counter(r[0] == 0 for r in told)[True] == sum(not (r["text"] or "").strip() for r in docs.collect())
