"""Quality classifier: a factorisation machine.

A text's features are its hashed words (weight 1 / number of words per
occurrence), bins of structure statistics (letter case, symbols, line and
word repetition, ...) and of length metadata taken from the text itself. The
score of features x is

    w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

(the sum-of-squares identity), so it costs time linear in the text. Word
features of a batch are looked up and summed by array operations.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import WordHasher, doc_chunks
from thinkframe.llm.sampling import fitted, fold, kept_share

WORD_BITS = 13
FACTORS = 8
SAMPLE_ROWS = 8192  # expected rows a model is fitted on, at most
EPOCHS = 12

# byte classes of the structure statistics
_CLASSES = ("upper", "lower", "digit", "space", "line", "bang", "pipe", "symbol", "punctuation", "other")


def _byte_classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), np.int64)
    for name, members in (
        ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("line", b"\n"), ("bang", b"!"), ("pipe", b"|"),
        ("symbol", b"#$%&*+<=>@[\\]^_`{}~/"), ("punctuation", b".,;:?'\"()-"),
    ):
        out[list(members)] = _CLASSES.index(name)
    return out


# Upper bounds of the bins; a value goes to the first bin whose bound is above it.
_SHARES = np.array([0.0005, 0.002, 0.006, 0.015, 0.03, 0.06, 0.12, 0.25, 0.5])
_STATS = {
    "upper": _SHARES, "digit": _SHARES, "line": _SHARES, "bang": _SHARES, "pipe": _SHARES, "symbol": _SHARES, "punctuation": _SHARES, "other": _SHARES,
    "same word before": _SHARES, "same word two before": _SHARES,
    "word length": np.array([2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 14.0]),
    "words": np.array([1.0, 4.0, 16.0, 64.0, 160.0, 400.0, 1000.0, 3000.0, 10000.0]),
    "words per line": np.array([2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0]),
}
BINS = 10
WORDS = 1 << WORD_BITS
SIZE = WORDS + BINS * len(_STATS)


class Features:
    """Word ids and statistic ids of Arrow text columns."""

    def __init__(self):
        self.hasher = WordHasher()
        self.classes = _byte_classes()

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word ids, row bounds, statistic ids: rows x statistics)."""
        hashes, bounds = self.hasher.documents(data, offsets)
        sizes = np.diff(offsets)
        n = len(sizes)
        rows = np.repeat(np.arange(n), sizes)
        text = data[offsets[0] : offsets[-1]]
        counts = np.bincount(rows * len(_CLASSES) + self.classes[text], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
        words = np.diff(bounds)
        row_of = np.repeat(np.arange(n), words)

        def repeats(step: int) -> np.ndarray:
            same = (hashes[step:] == hashes[:-step]) & (row_of[step:] == row_of[:-step])
            return np.bincount(row_of[step:][same], minlength=n) / np.maximum(words, 1)

        values = {c: counts[:, i] / np.maximum(sizes, 1) for i, c in enumerate(_CLASSES)}
        values |= {"same word before": repeats(1), "same word two before": repeats(2), "words": words.astype(float)}
        values |= {"word length": (sizes - values["space"] * sizes) / np.maximum(words, 1), "words per line": words / (counts[:, _CLASSES.index("line")] + 1)}
        stats = np.stack([WORDS + BINS * j + np.searchsorted(edges, values[name], side="right") for j, (name, edges) in enumerate(_STATS.items())], axis=1)
        return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), bounds, stats


def _sums(table: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, the sum of ``table`` over its ids (no ids: 0)."""
    out = np.zeros((len(bounds) - 1, table.shape[1]), table.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(table[ids], bounds[some], axis=0)
    return out


def _parts(w: np.ndarray, v: np.ndarray, ids: np.ndarray, bounds: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linear, sum v x, sum v^2 x^2) of every row."""
    table = np.concatenate([w[:, None], v, (v * v).sum(axis=1, keepdims=True)], axis=1)
    share = 1 / np.maximum(np.diff(bounds), 1)[:, None].astype(table.dtype)
    words = _sums(table, ids, bounds)
    fixed = table[stats].sum(axis=1)
    return words[:, 0] * share[:, 0] + fixed[:, 0], words[:, 1:-1] * share + fixed[:, 1:-1], words[:, -1] * share[:, 0] ** 2 + fixed[:, -1]


def raw_scores(model: dict, ids: np.ndarray, bounds: np.ndarray, stats: np.ndarray) -> np.ndarray:
    linear, cross, squares = _parts(model["w"], model["v"], ids, bounds, stats)
    return model["w0"] + linear + 0.5 * ((cross * cross).sum(axis=1) - squares)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -40, 40) / 2))


def train(ids: list[np.ndarray], stats: np.ndarray, y: np.ndarray, seed: int = 5) -> dict:
    """Log loss by AdaGrad over mini-batches; fixed order and seed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    share = min(max(y.mean(), 0.01), 0.99)
    model = {"w0": float(np.log(share / (1 - share))), "w": np.zeros(SIZE, np.float32), "v": rng.normal(0, 0.03, (SIZE, FACTORS)).astype(np.float32)}
    past_w, past_v = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            own = [ids[i] for i in rows]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            flat, st = np.concatenate(own), stats[rows]
            w, v = model["w"], model["v"]
            linear, cross, squares = _parts(w, v, flat, bounds, st)
            error = (_logistic(model["w0"] + linear + 0.5 * ((cross * cross).sum(axis=1) - squares)) - y[rows]) / len(rows)
            x = np.repeat(1 / np.maximum(np.diff(bounds), 1), np.diff(bounds))
            row_of = np.concatenate([np.repeat(np.arange(len(rows)), np.diff(bounds)), np.repeat(np.arange(len(rows)), st.shape[1])])
            features, x = np.concatenate([flat, st.reshape(-1)]), np.concatenate([x, np.ones(st.size)])
            pull = error[row_of] * x
            touched = np.bincount(features, minlength=SIZE) > 0
            grad_w = np.bincount(features, pull, SIZE) + 1e-4 * w * touched
            linear_v, own_v = np.stack([np.bincount(features, pull * cross[row_of, f], SIZE) for f in range(FACTORS)], axis=1), np.bincount(features, pull * x, SIZE)
            grad_v = linear_v - own_v[:, None] * v + 1e-4 * v * touched[:, None]
            past_w += (grad_w * grad_w).astype(np.float32)
            past_v += (grad_v * grad_v).astype(np.float32)
            model["w"] = (w - 0.2 * grad_w / np.sqrt(past_w)).astype(np.float32)
            model["v"] = (v - 0.02 * grad_v / np.sqrt(past_v)).astype(np.float32)
            model["w0"] -= 0.05 * float(error.sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", held_out: tuple[int, int] = (5, 0), rows: int = SAMPLE_ROWS, seed: int = 5) -> dict | None:
    """A model from at most about ``rows`` labelled documents.

    Documents whose crc32(key as text) mod held_out[0] is held_out[1], null
    labels and null keys are never learned from. Several labels of a key are
    averaged. No labelled rows: None.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("__y"))
    known = known.where(fold(F.col(key), held_out[0]) != held_out[1])
    n = known.count()
    if not n:
        return None
    chosen = known.where(kept_share(F.col(key), min(1.0, rows / n), seed))
    train_rows = docs.select(F.col(key), F.col(text).alias("__t")).join(chosen, key).select(F.col(key).cast("long"), "__t", "__y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for batch in batches:
            for first, last, data, offsets in doc_chunks(batch.column(1)):
                ids, bounds, stats = own.of(data, offsets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:last], batch.column(2)[first:last],
                    pa.array([ids[a:b].astype(np.uint16).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.array([s.astype(np.uint16).tobytes() for s in stats], pa.binary()),
                ], names=["k", "y", "ids", "stats"])

    def learn(frame: pd.DataFrame) -> bytes:
        frame = frame.sort_values(["k", "ids"], ignore_index=True)
        ids = [np.frombuffer(x, np.uint16).astype(np.int64) for x in frame["ids"]]
        stats = np.stack([np.frombuffer(x, np.uint16).astype(np.int64) for x in frame["stats"]])
        out = io.BytesIO()
        np.savez(out, **train(ids, stats, frame["y"].to_numpy(float)))
        return out.getvalue()

    blob = fitted(train_rows.mapInArrow(features, "k long, y int, ids binary, stats binary"), learn)
    if not blob:
        return None
    found = np.load(io.BytesIO(blob))
    return {"w0": float(found["w0"]), "w": found["w"], "v": found["v"]}


def score(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the model's probability of label 1 (0 to 1).

    Only the text is read; a null text is empty and gets the score of an empty
    text. Without a model every score is 0.5. All other columns and all rows
    stay; a column of that name is replaced.
    """
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score_all(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, model = Features(), shared.value
        for texts in columns:
            if model is None:
                yield pa.array(np.full(len(texts), 0.5))
                continue
            parts = [_logistic(raw_scores(model, *own.of(data, offsets))) for _, _, data, offsets in doc_chunks(texts)]
            yield pa.array(np.concatenate(parts).astype(float) if parts else np.zeros(0))

    return docs.withColumn(column, F.arrow_udf(score_all, "double")(F.col(text)))
