"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, SF, no_docs, odd_docs, real_docs, same_rows
from thinkframe.llm import spelling
from thinkframe.llm.queries import QUERIES


def near(a, b):
    """One letter inserted, deleted or replaced, by the definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_length=7, least_count=2, times=10, one_in=31):
    total = Counter()
    for i, t in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}
    deleted = {}  # words that share a word with one letter less are the only candidates
    for w in words:
        for i in range(len(w)):
            deleted.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        deleted.setdefault(w, set()).add(w)
    links = {w: set() for w in words}
    for group in deleted.values():
        for a in group:
            links[a] |= {b for b in group if a != b and near(a, b)}
    form = {}
    for w, others in links.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= times * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(links[w]), words[form[w]] if w in form else None))
    return out


def checked(spark, rows, partitions=4, **how):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).repartition(partitions)
    same_rows(spelling.variants(docs, **how), brute(rows, **how))


def test_real_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in real_docs(spark).collect()]
    want = brute(rows)
    assert any(r[1] for r in want)
    same_rows(QUERIES["op11_spelling_variants"](spark, SF), want)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_documents(spark, clashing):
    docs = odd_docs(spark, clashing)
    if clashing:
        for name in ("word", "n", "form", "root", "cell"):
            docs = docs.withColumn(name, F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same_rows(spelling.variants(docs, least_length=2, least_count=1), brute(rows, least_length=2, least_count=1))


def test_empty_and_wordless_tables(spark):
    out = spelling.variants(no_docs(spark))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    checked(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "short")])


def made_words(rng, count, length, letters):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(*length))) for _ in range(count)]


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzàÿÀ"])
def test_random_words(spark, letters):
    rng = random.Random(len(letters))
    base = made_words(rng, 150, (3, 9), letters)
    words = list(base)
    for w in base * 3:
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]]))
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + f" {words[i % 7]}" * 40) for i in range(30)]
    checked(spark, rows, least_length=1, least_count=1, times=3)


def test_chains_of_forms_reach_the_last(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    rows = [(i, " ".join([w] * 2**k)) for i, (k, w) in enumerate(zip((0, 2, 4, 6, 8, 10), chain, strict=True))]
    checked(spark, rows, least_count=1, times=4, one_in=0)


def test_ties_take_the_smallest_word(spark):
    rows = [(1, "letters " * 1 + "letterz " * 20 + "lettera " * 20 + "letterss " * 20), (2, "ÀLETTERS àletters " * 3)]
    checked(spark, rows, least_count=1, one_in=0)


def test_large_cells_are_split_and_nothing_is_lost(spark, monkeypatch):
    """Cells cut by the trees, then member and visitor blocks of a few words."""
    rng = random.Random(11)
    words = made_words(rng, 900, (7, 9), "abcd")
    rows = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(8)]
    monkeypatch.setattr(spelling, "CELL", 64)
    checked(spark, rows, one_in=0)
    monkeypatch.setattr(spelling, "SAMPLE", 100)  # a poor tree
    monkeypatch.setattr(spelling, "BLOCK_BYTES", 500)
    monkeypatch.setattr(spelling, "VISITORS", 60)
    checked(spark, rows, one_in=0)


def test_long_words(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("xyz") for _ in range(n)) for n in (63, 64, 65, 66, 300, 5000)]
    words = base + [w[:-1] for w in base] + [w[:20] + "q" + w[21:] for w in base] + ["a" * 300, "a" * 301, "b" + "a" * 299]
    checked(spark, [(i, " ".join(words)) for i in range(3)], one_in=0)


def test_texts_are_tokenised_in_pieces_that_cut_no_run():
    rng = random.Random(1)
    text = "".join(rng.choice("abé 1") for _ in range(5000)) + "z" * 300
    for size in (1, 7, 100):
        found = [r for piece in spelling.pieces(text, size) for r in spelling.RUN.findall(piece)]
        assert found == spelling.RUN.findall(text)


def test_tree_reaches_every_point_in_the_box():
    rng = np.random.default_rng(6)
    points = rng.integers(0, 4, (500, spelling.LETTERS)) * (rng.random((500, spelling.LETTERS)) < 0.05)
    tree = spelling.Tree(points.astype(np.uint8), 8)
    queries = np.clip(points[rng.integers(0, 500, 200)] + rng.integers(-1, 2, (200, spelling.LETTERS)) * (rng.random((200, spelling.LETTERS)) < 0.02), 0, 255)
    for up, down in ((1, 1), (1, 0), (0, 0), (2, 3)):
        seen = {(int(q), int(m)) for leaf, rows in tree.reached(queries.astype(np.uint8), up, down) for q in rows for m in tree.rows[leaf]}
        gap = points[None] - queries[:, None]
        want = (np.maximum(gap, 0).sum(axis=2) <= up) & (np.maximum(-gap, 0).sum(axis=2) <= down)
        assert {(int(q), int(m)) for q, m in zip(*np.nonzero(want), strict=True)} <= seen
        assert len(seen) < 0.7 * want.size
