"""Token encoding, token files and their planes."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, no_docs, odd_docs, real_docs, vocabulary
from thinkframe.llm import tokenfile
from thinkframe.session import shared_path
from thinkframe.llm.tokens import Encoder


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain, spark):
    own, rng = Encoder(vocabulary()), random.Random(3)
    parts = list("aàb1²'s \n\t\r  ..!|$éZ,") + ["'ll", " the", "word.", "two,", "a.\nB", "\x1c", "漢", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [r["text"] for r in real_docs(spark).limit(60).collect()] + [t for _, t, _, _ in ODD]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain(text), repr(text)[:80]


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|endoftext|> hello", "hello <|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|> c", "<|endoftext|", "< |endoftext|>"])
def test_special_strings_in_a_text(plain, text):
    ids = np.frombuffer(Encoder(vocabulary()).ids(text), "<u4").tolist()
    assert ids == plain(text) and ids.count(50256) == text.count("<|endoftext|>")


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(unit, n):
    ids = np.random.Generator(np.random.PCG64(n)).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = tokenfile.planes_of(ids, unit)
    assert len(planes) == (4 if unit == "byte" else 32)
    assert tokenfile.ids_of(planes, n, unit).tolist() == ids.tolist()


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_file_round_trip_by_block(unit):
    ids = np.arange(1000, dtype="<u4") * 77
    content = tokenfile.pack_file(3, 4, [5, None], [600, 400], ids.tobytes(), unit, block=256)
    header, keys, lengths, base = tokenfile.open_file(content)
    assert (header["part"], header["seq"], keys, lengths, len(header["chunks"])) == (3, 4, [5, None], [600, 400], 4)
    assert tokenfile.read_block(content, header, base, 2).tolist() == ids[512:768].tolist()


@pytest.mark.parametrize("file_ids", [50, 1 << 20])
def test_written_files_give_every_document_back(spark, plain, file_ids):
    docs = odd_docs(spark, clashing=True)
    path = shared_path(spark, "test-token-files")
    tokenfile.write_token_files(docs, path, vocabulary(), end_id=0, block=64, file_ids=file_ids)
    rows = tokenfile.read_token_files(spark, path).orderBy("part", "seq", "idx").collect()
    key = lambda k: (k is not None, k or 0)
    assert [r["key"] for r in rows] == sorted((i for i, *_ in ODD), key=key)
    texts = sorted((str(i), plain(t)) for i, t, _, _ in ODD)
    assert sorted((str(r["key"]), np.frombuffer(bytes(r["ids"]), "<u4").tolist()[:-1]) for r in rows) == texts
    at = 0
    found = {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.token_positions(spark, path).collect()}
    for r in rows:
        assert (at, r["n_tokens"], zlib.crc32(bytes(r["ids"]))) in found
        at += r["n_tokens"]


def test_no_documents(spark):
    path = shared_path(spark, "test-token-files")
    tokenfile.write_token_files(no_docs(spark), path, vocabulary())
    assert tokenfile.token_positions(spark, path).count() == 0
