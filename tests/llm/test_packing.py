"""Best-fit packing: invariants and near-minimal numbers of sequences."""

import zlib

import numpy as np
import pytest

from tests.llm.helpers import ODD, no_docs, odd_docs, real_docs, vocabulary
from thinkframe.llm import packing
from thinkframe.llm.tokens import Encoder


def check(rows, max_tokens, max_documents, max_attention):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= max_tokens and len(parts) <= max_documents and sum(n * n for _, n in parts) <= max_attention
    return len(bins)


@pytest.mark.parametrize("clashing", [False, True])
def test_every_token_is_packed_once(spark, clashing):
    own = Encoder(vocabulary())
    rows = packing.pack_documents(odd_docs(spark, clashing), vocabulary(), 64, 2, 64, 64 * 64).collect()
    check(rows, 64, 64, 64 * 64)
    for key in {i for i, *_ in ODD}:
        texts = [own.ids(t) + (2).to_bytes(4, "little") for i, t, _, _ in ODD if i == key]
        want = []
        for ids in texts:
            n = len(ids) // 4
            first = n - (-(-n // 64) - 1) * 64
            cuts = [0, *range(first, n + 1, 64)]
            want += [(p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        got = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == key]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(1024, 1024, 1024 * 1024), (1024, 3, 1024 * 1024), (1024, 1024, 600_000)])
def test_limits_hold_under_both_rules(spark, rule, limits):
    rng = np.random.Generator(np.random.PCG64(1))
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 700, 1500))], "doc_id long, length long")
    packed = packing.pack(pieces, *limits, order=("doc_id",), rule=rule, group_pieces=500).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(1500))
    check(packed, *limits)


def test_few_sequences(spark):
    packed = packing.pack_documents(real_docs(spark), vocabulary(), 1024, 2, 1024, 1024 * 1024).collect()
    n = check(packed, 1024, 1024, 1024 * 1024)
    assert n <= np.ceil(sum(r["length"] for r in packed) / 1024) * 1.02 + 1


def test_reruns_agree(spark):
    run = lambda: sorted(map(tuple, packing.pack_documents(real_docs(spark), vocabulary(), 512, 2, 64, 512 * 512).collect()))
    assert run() == run()


def test_a_piece_that_fits_nowhere_stops_the_job(spark):
    with pytest.raises(Exception, match="larger than a sequence"):
        packing.pack(spark.createDataFrame([(1, 20)], "doc_id long, length long"), 10, 10, 100).collect()


def test_no_documents(spark):
    assert packing.pack_documents(no_docs(spark), vocabulary(), 64, 2, 64, 64 * 64).count() == 0
