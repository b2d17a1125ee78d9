"""Language identification, families first.

Hashed byte n-grams of the lower-cased letters of a text feed two levels of
linear support vector machines: one per language family against the rest
chooses the family; then one-versus-one machines separate the languages
within it (most votes, then the larger sum of margins, then the smaller code).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import doc_chunks
from thinkframe.llm.sampling import fitted, fold, kept_share

BITS = 12
SIZE = 1 << BITS
PER_LANGUAGE = 1000  # expected texts per language a model is fitted on
TEXTS = 8000  # expected texts over all languages, at most
UNKNOWN = "und"

# Families of common ISO 639-1 codes; any other code is its own family.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la co sc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tk tt ug",
    "indo-aryan": "hi ur bn pa gu mr ne si or as sd",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt ti",
    "austronesian": "id ms tl jv su mg mi",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


class Grams:
    """Rows x SIZE features: square roots of n-gram shares, unit length."""

    def __init__(self):
        self.letter = np.zeros(256, np.uint32)
        self.letter[97:123] = np.arange(97, 123)
        self.letter[128:] = np.arange(128, 256)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, SIZE), np.float32)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            counts = np.zeros(SIZE, np.int64)
            for at in range(a, b, 1 << 20):  # long texts by pieces that overlap by two bytes
                piece = np.zeros(min(b, at + (1 << 20)) - max(a, at - 2) + 2, np.uint32)
                piece[1:-1] = self.letter[data[max(a, at - 2) : min(b, at + (1 << 20))]]
                pairs = piece[:-1] * np.uint32(40503) + piece[1:]
                threes = (pairs[:-1] * np.uint32(40503) + piece[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
                counts += np.bincount(threes[piece[1:-1] > 0], minlength=SIZE)
            out[i] = np.sqrt(counts / max(1, counts.sum()))
        return out


def _machine(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 80) -> np.ndarray:
    """Weights (and a last bias) of a squared-hinge linear SVM, classes weighted
    alike, by accelerated gradient descent; ``y`` is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, look, bias, bias_look, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0, 1 / (1 / 50 + 4 * c)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look + bias_look))
        pull = (weight * slack * y).astype(np.float32)
        new, new_bias = look - step * (look / 50 - 2 * c * (pull @ x)), bias_look + step * 2 * c * float(pull.sum())
        speed = t / (t + 3)
        look, bias_look = new + speed * (new - w), new_bias + speed * (new_bias - bias)
        w, bias = new, new_bias
    return np.append(w, np.float32(bias))


def train(x: np.ndarray, langs: list[str]) -> dict:
    """Family machines and, within families, one machine per pair of languages."""
    known = sorted(set(langs))
    lang = np.array([known.index(a) for a in langs])
    family = [FAMILY_OF.get(a, f"only {a}") for a in known]
    families = sorted(set(family))
    own = np.array([families.index(f) for f in family])
    tops = [_machine(x, np.where(own[lang] == f, 1.0, -1.0).astype(np.float32)) for f in range(len(families))] if len(families) > 1 else []
    pairs = [(a, b) for a, b in combinations(range(len(known)), 2) if own[a] == own[b]]
    below = []
    for a, b in pairs:
        rows = np.flatnonzero((lang == a) | (lang == b))
        below.append(_machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0).astype(np.float32)))
    return {"langs": known, "family": own.tolist(), "families": len(families), "pairs": pairs, "tops": np.array(tops, np.float32).reshape(-1, x.shape[1] + 1), "below": np.array(below, np.float32).reshape(-1, x.shape[1] + 1)}


def _sure(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(2 * margin, -20, 20)))


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score from 0 to 1) of every row."""
    own, langs = np.array(model["family"]), model["langs"]
    if len(model["tops"]):
        margins = x @ model["tops"][:, :-1].T + model["tops"][:, -1]
        family = margins.argmax(axis=1)
        score = _sure(margins[np.arange(len(x)), family])
    else:
        family, score = np.zeros(len(x), int), np.ones(len(x))
    votes, sums, least = np.zeros((len(x), len(langs))), np.zeros((len(x), len(langs))), np.full((len(x), len(langs)), np.inf)
    if model["pairs"]:
        margins = x @ model["below"][:, :-1].T + model["below"][:, -1]
        for j, (a, b) in enumerate(model["pairs"]):
            for k, m in ((a, margins[:, j]), (b, -margins[:, j])):
                votes[:, k] += m > 0
                sums[:, k] += m
                least[:, k] = np.minimum(least[:, k], m)
    rank = np.where(own[None, :] == family[:, None], votes + 0.5 * np.tanh(sums / max(1, len(langs))) + len(langs), -np.inf)
    best = rank.argmax(axis=1)
    inner = least[np.arange(len(x)), best]
    return best, score * np.where(np.isinf(inner), 1.0, _sure(np.where(np.isinf(inner), 0, inner)))


def _lowered(docs: DataFrame, text: str):
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: tuple[int, int] = (4, 2), per_language: int = PER_LANGUAGE, texts: int = TEXTS, seed: int = 3) -> dict | None:
    """A model from about ``per_language`` texts of every language (``texts``
    in all, at most), chosen by a hash of the key.

    Rows whose crc32(key as text) mod held_out[0] is held_out[1], null keys,
    null languages and texts without letters are never learned from. None if
    nothing is left.
    """
    known = docs.where(F.col(lang).isNotNull() & (fold(F.col(key), held_out[0]) != held_out[1]))
    counts = known.groupBy(lang).count().collect()  # one row per language
    if not counts:
        return None
    most = min(per_language, max(1, texts // len(counts)))
    chosen = F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col(lang) == r[0]) & kept_share(F.col(key), min(1.0, most / r["count"]), seed))
    rows = known.where(chosen).where(F.col(text).rlike(r"\p{L}")).select(F.col(key).cast("long").alias("k"), F.col(lang).alias("l"), _lowered(docs, text).alias("t"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grams()
        for batch in batches:
            for first, last, data, offsets in doc_chunks(batch.column(2)):
                x = own.of(data, offsets)
                at = [np.flatnonzero(r).astype(np.uint16) for r in x]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:last], batch.column(1)[first:last],
                    pa.array([i.tobytes() for i in at], pa.binary()), pa.array([r[i].tobytes() for r, i in zip(x, at, strict=True)], pa.binary()),
                ], names=["k", "l", "at", "x"])

    def learn(frame: pd.DataFrame) -> bytes:
        frame = frame.sort_values(["k", "l"], ignore_index=True)
        x = np.zeros((len(frame), SIZE), np.float32)
        for i, (at, values) in enumerate(zip(frame["at"], frame["x"], strict=True)):
            x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(values, np.float32)
        model = train(x, frame["l"].tolist())
        out = io.BytesIO()
        np.savez(out, tops=model.pop("tops"), below=model.pop("below"), rest=np.frombuffer(json.dumps(model).encode(), np.uint8))
        return out.getvalue()

    blob = fitted(rows.mapInArrow(grams, "k long, l string, at binary, x binary"), learn)
    if not blob:
        return None
    found = np.load(io.BytesIO(blob))
    return json.loads(found["rest"].tobytes()) | {"tops": found["tops"], "below": found["below"]}


def identify(docs: DataFrame, model: dict | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score (0 to 1), named ``names``.

    A null text, one without a letter, or any text without a model is "und"
    with score 0. Only the text is read; other columns and all rows stay;
    columns of those two names are replaced.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, model = Grams(), shared.value
        for texts in columns:
            names, scores = [], []
            for _, _, data, offsets in doc_chunks(texts):
                best, score = predict(model, own.of(data, offsets))
                names += [model["langs"][i] for i in best]
                scores.append(score)
            score = np.concatenate(scores).astype(float) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    if model is None:
        return docs.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("__guess", F.arrow_udf(guess, "lang_pred string, score double")(_lowered(docs, text)))
    lang_pred = F.when(lettered, F.col("__guess.lang_pred")).otherwise(UNKNOWN)
    return found.withColumns({names[0]: lang_pred, names[1]: F.when(lettered, F.col("__guess.score")).otherwise(0.0)}).drop("__guess")
