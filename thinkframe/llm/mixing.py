"""Mixing sources to target weights with exact block quotas.

Every source's documents are dealt by a hash of their contents into blocks
(a power of two per source, about ``BLOCK_ROWS`` documents each). A source's
target is met by whole epochs of all its blocks plus a last, partial epoch: in
hash order every document that still fits the words left, to the end of the
source. A document that does not fit is left out and smaller ones after it are
tried. Where that leaves more than a thousandth of the target open (a document
as long as many others), the smallest document left out is put in and others
are taken out, in the same way, for its excess. The
fill runs in passes over narrow rows, all sources at once: block sums of what
still fits, then, document by document, the one block in which it runs over.

The draws (block, epoch) of all sources are then split among output shards by
a multivariate-hypergeometric tree: each node hands an exact random share of
every source's quota to its left half, until single shards hold exact
quotas. A shard draws its quota as a disjoint range of the source's permuted
blocks, and shuffles its documents locally. Shards follow the words of the mix.

Texts move only to their shard (``drawn``): the choice is arithmetic on a
document's own hash and one small row per source. The driver sees one row per
source (name, words, documents, plan), never documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.llm.common import written

BLOCK_ROWS = 256
SHARD_WORDS = 1 << 21  # of the mix in an output shard,
MOST_SHARDS = 1 << 16  # more of them only beyond so many shards: the plan has a number per source and shard
TOP = -(1 << 63)  # turns the order of signed numbers into that of unsigned ones
ADDED = ("size", "source_size", "target", "copies", "shards")
CELL_BITS = 16  # most blocks a source can have: 2**16


def word_count(text: str) -> Column:
    """Runs without white space (space, \\t \\n \\v \\f \\r); null: 0."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.octet_length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def reshared_targets(sizes: Sequence[float], weights: Sequence[float], total: float, ceiling: float) -> np.ndarray:
    """Shares of ``total`` by weight; what exceeds ``ceiling`` times a size is
    shared again among the others by weight, until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        share = (total - out[~open_].sum()) * weights / weights[open_].sum()
        over = open_ & (share > ceiling * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over], open_ = ceiling * sizes[over], open_ & ~over
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources x shards) quotas: the tree of multivariate hypergeometric draws."""
    out = np.zeros((len(quotas), shards), np.int64)
    nodes = [(0, shards, np.asarray(quotas, np.int64))]
    while nodes:
        first, last, own = nodes.pop()
        if last - first == 1:
            out[:, first] = own
            continue
        middle = (first + last) // 2
        take = int(own.sum()) * (middle - first) // (last - first)
        left = rng.multivariate_hypergeometric(own, take, method="marginals") if len(own) else own
        nodes += [(first, middle, left), (middle, last, own - left)]
    return out


def _stride(m: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, c): b -> (a * b + c) mod m is a permutation of range(m)."""
    a = int(rng.integers(1, max(2, m)))
    while math.gcd(a, m) != 1:
        a += 1
    return a, int(rng.integers(0, m))


def _spans(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's block in which the documents that a span takes run over the
    words left; a row per document hash, none of more words than the span takes.

    Returns the spans (first, last, most words) that end in the block, and of
    the one that is open at its end: first, most, and the words left."""
    frame = frame.sort_values("u")
    spans, first, most = [], int(frame["first"].iloc[0]), float(frame["most"].iloc[0])
    left = float(frame["left"].iloc[0]) - float(frame["before"].iloc[0])
    for u, words in zip(frame["u"], frame["w"], strict=True):
        if words <= left:
            left -= float(words)
        elif words <= most:  # the span would take it: it ends before
            spans.append((first, int(u) - 1, most))
            first, most = int(u) + 1, left
    return pd.DataFrame({"s": frame["s"].iloc[:1].to_numpy(), "b": frame["b"].iloc[:1].to_numpy(), "spans": [spans], "first": [first], "most": [most], "left": [left]})


SPANS = "array<struct<first:bigint,last:bigint,most:double>>"


def _block(place: Column, bits: Column) -> Column:
    """A document's block: the first bits of its hash."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", place.bitwiseXOR(F.lit(TOP)), (64 - bits).cast("int")))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.withColumnRenamed("s", "__s"), F.col("s").eqNullSafe(F.col("__s"))).drop("__s")


def fill(hashed: DataFrame, rest: dict[str | None, float], bits: dict[str | None, int]) -> dict[str | None, tuple[list, int, float]]:
    """For every source of ``rest`` (words wanted) the spans of its last epoch,
    the blocks up to the first one that ran over, and the words that are left.

    ``hashed``: (s, u, w), the words per source and place u of a document in
    hash order. Taken is in that order every document of at least a word that
    fits the words left. A span (first, last, most) takes the documents from
    place first to last that have ``most`` words or fewer.
    """
    spark = hashed.sparkSession
    low, high = TOP, -TOP - 1
    done = {s: ([], 0, float(r)) for s, r in rest.items()}
    # per source: where the search goes on, and the open span with the words left
    open_ = {s: {"next": low, "first": low, "most": r, "left": r, "spans": []} for s, r in rest.items() if r >= 1}
    while open_:
        rows = [(s, x["next"], x["first"], x["most"], x["left"], bits[s]) for s, x in open_.items()]
        plan = spark.createDataFrame(rows, "s string, next long, first long, most double, left double, bits int")
        still = _joined(hashed, plan).where("u >= next and w > 0 and w <= most").withColumn("b", _block(F.col("u"), F.col("bits")))
        blocks = still.groupBy("s", "b", "left").agg(F.sum("w").alias("w"))
        run = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        over = blocks.withColumn("upto", F.sum("w").over(run)).where(F.col("upto") > F.col("left"))
        over = over.groupBy("s").agg(F.min(F.struct("b", (F.col("upto") - F.col("w")).alias("before"))).alias("x")).select("s", F.col("x.b").alias("cut"), F.col("x.before").alias("before"))
        inside = _joined(still, written(over, "full-blocks")).where(F.col("b") == F.col("cut"))
        ends = inside.groupBy("s").applyInPandas(_spans, f"s string, b long, spans {SPANS}, first long, most double, left double").collect()
        ends = {r["s"]: r for r in ends}
        whole = {r["s"]: float(r["w"]) for r in blocks.groupBy("s").agg(F.sum("w").alias("w")).collect()} if len(ends) < len(open_) else {}
        for s in list(open_):
            x, r = open_[s], ends.get(s)
            x["left"] -= whole.get(s, 0.0) if r is None else 0.0
            if r is not None:
                x["blocks"] = x.get("blocks", r["b"] + 1)
                x["spans"] += [tuple(y) for y in r["spans"]]
                x |= {"first": r["first"], "most": r["most"], "left": r["left"], "next": ((r["b"] + 1) << (64 - bits[s])) + TOP}
            if r is None or x["next"] > high or x["left"] < 1:  # all that fits is in
                done[s] = (x["spans"] + ([(x["first"], high, x["most"])] if x["first"] <= high else []), x.get("blocks", 1 << bits[s]), x["left"])
                del open_[s]
    return done


def _in(spans: str, place: str, words: str) -> Column:
    return F.expr(f"{words} > 0 and exists({spans}, x -> {place} between x.first and x.last and {words} <= x.most)")


def exchange(hashed: DataFrame, last: dict, targets: dict[str | None, float], bits: dict[str | None, int]) -> dict[str | None, tuple[int, list]]:
    """For sources that ``fill`` left short by more than a thousandth of their
    target: (place of the smallest document left out, spans of what goes for
    it), where that comes nearer."""
    short = {s: x for s, x in last.items() if x[2] > targets[s] / 1000 and x[0]}
    if not short:
        return {}
    plan = hashed.sparkSession.createDataFrame([(s, x[0]) for s, x in short.items()], f"s string, spans {SPANS}")
    marked = _joined(hashed, plan).withColumn("taken", _in("spans", "u", "w"))
    least = marked.where("not taken and w > 0").groupBy("s").agg(F.min(F.struct("w", "u")).alias("x")).collect()
    least = {r["s"]: (r["x"]["u"], r["x"]["w"] - short[r["s"]][2]) for r in least}
    gone = fill(written(marked.where("taken").select("s", "u", "w"), "taken"), {s: float(over) for s, (_, over) in least.items()}, bits)
    return {s: (least[s][0], spans) for s, (spans, _, over) in gone.items() if over < short[s][2]}


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3),
        share: float = 1.0, ceiling: int = 3, shards: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``copies``
    (times the mix takes the document) and ``shards`` (the output shard of
    each copy; the column's metadata has their ``count``).

    Sources in code-point order, null last, weigh ``weights`` in turn and
    share ``share`` of all words; no source or document is taken more than
    ``ceiling`` times. A source's taken words miss its target by less than the
    smallest document that its last epoch leaves out, or could take out
    instead. Null and wordless texts have size 0 and are in whole epochs only. Equal seeds and
    rows give equal mixes, whatever the partitioning; rows equal in key and
    text move together. ``shards`` are one per ``SHARD_WORDS`` of the mix if not
    given, ``MOST_SHARDS`` at most. An empty table stays empty. Columns of those
    five names are replaced.
    """
    docs = docs.drop(*ADDED)
    sized = docs.withColumn("size", word_count(text)).withColumn("__h", F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    narrow = sized.select(F.col(source).cast("string").alias("s"), F.col("__h").bitwiseXOR(F.lit(TOP)).alias("u"), "size")
    narrow = written(narrow.groupBy("s", "u").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")), "sizes")

    rows = narrow.groupBy("s").agg(F.sum("w").alias("words"), F.sum("n").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["s"] is None, (r["s"] or "").encode()))
    size = np.array([r["words"] for r in rows], float)
    targets = reshared_targets(size, [weights[i % len(weights)] for i in range(len(rows))], share * size.sum(), ceiling)
    bits = [min(CELL_BITS, max(0, math.ceil(math.log2(r["n"] / BLOCK_ROWS)))) for r in rows]
    epochs = [min(ceiling, int(t / w + 1e-9)) if w else 0 for t, w in zip(targets, size, strict=True)]
    rest = {r["s"]: float(max(0.0, t - e * w)) if e < ceiling else 0.0 for r, t, e, w in zip(rows, targets, epochs, size, strict=True)}
    by_source = {r["s"]: b for r, b in zip(rows, bits, strict=True)}
    last = fill(narrow.select("s", "u", "w"), rest, by_source)
    swaps = exchange(narrow.select("s", "u", "w"), last, {r["s"]: t for r, t in zip(rows, targets, strict=True)}, by_source)

    if shards is None:
        shards = min(MOST_SHARDS, max(1, math.ceil(targets.sum() / SHARD_WORDS)))
    step = math.isqrt(shards - 1) + 1 if shards > 1 else 1  # a shard is found among every step-th bound, then among step of them
    rng = np.random.Generator(np.random.PCG64(seed))
    quotas = np.array([e * (1 << b) + last[r["s"]][1] for r, e, b in zip(rows, epochs, bits, strict=True)], np.int64)
    upto = np.cumsum(split_quotas(quotas, shards, rng), axis=1)
    plan = []
    for r, w, t, e, b, bound in zip(rows, size, targets, epochs, bits, upto, strict=True):
        spans, blocks, _ = last[r["s"]]
        m = [1 << b] * e + [max(1, blocks)]
        a, c = zip(*[_stride(x, rng) for x in m], strict=True)
        bound = [int(x) for x in bound]
        plan.append((r["s"], int(w), float(t), e, b, spans, *swaps.get(r["s"], (None, [])), m, list(a), list(c), bound, bound[step - 1 :: step]))
    schema = f"s string, source_size long, target double, __epochs int, __bits int, __spans {SPANS}, __in long, __out {SPANS}, __m array<long>, __a array<long>, __c array<long>, __upto array<long>, __every array<long>"
    plan = written(docs.sparkSession.createDataFrame(plan, schema).coalesce(1), "mix-plan")

    out = sized.join(plan, F.col(source).cast("string").eqNullSafe(F.col("s")))
    out = out.withColumn("__u", F.col("__h").bitwiseXOR(F.lit(TOP))).withColumn("__b", _block(F.col("__u"), F.col("__bits"))).withColumn("__w", F.col("size"))
    again = narrow.where("n > 1").select("s", "u", F.col("w").alias("__whole"))
    if again.head(1):  # rows equal in key and text fit together or not at all
        again = again.select(F.col("s").alias("__s"), F.col("u").alias("__v"), "__whole")
        out = out.join(again, (F.col("__u") == F.col("__v")) & F.col("s").eqNullSafe(F.col("__s")), "left").withColumn("__w", F.coalesce("__whole", "size"))
    taken = (_in("__spans", "__u", "__w") & ~_in("__out", "__u", "__w")) | F.coalesce(F.col("__u") == F.col("__in"), F.lit(False))
    out = out.withColumn("copies", F.least(F.col("__epochs") + taken.cast("int"), F.lit(ceiling)))
    place = "e * shiftleft(1L, __bits) + pmod(__a[e] * __b + __c[e], __m[e])"
    count = "(n, x) -> n + if(x <= p, 1, 0)"
    out = out.withColumn("__places", F.expr(f"transform(filter(sequence(0, __epochs), e -> e < copies), e -> {place})"))
    out = out.withColumn("__groups", F.expr(f"transform(__places, p -> aggregate(__every, 0, {count}))"))
    fine = f"__groups[i] * {step} + aggregate(slice(__upto, __groups[i] * {step} + 1, {step}), 0, {count})"
    out = out.withColumn("__shards", F.expr(f"transform(__places, (p, i) -> cast({fine} as int))"))
    return out.select(*[docs[c] for c in docs.columns], *ADDED[:-1], F.col("__shards").alias("shards", metadata={"count": shards}))


def drawn(mixed: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """One row per taken copy of a ``mix`` with ``shard``, a partition per shard,
    shuffled within each shard."""
    count = mixed.schema["shards"].metadata.get("count", 1)
    copies = mixed.select("*", F.posexplode("shards").alias("__epoch", "shard")).drop("shards", "copies")
    order = F.xxhash64(F.lit(seed), "shard", "__epoch", key)
    return copies.repartitionById(count, F.col("shard")).withColumn("__order", order).sortWithinPartitions("shard", "__order").drop("__order", "__epoch")
