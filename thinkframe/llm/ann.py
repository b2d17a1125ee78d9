"""Approximate nearest neighbours with a hash-prefix forest.

Each of ``TREES`` trees gives every vector a string of ``BITS`` sign bits of
random projections; a tree is the sorted array of these strings. A query
descends to its longest-prefix match in every tree and ascends in all trees
at once, level by level, until the vectors under its prefixes are enough. How
many are enough is not guessed: the exact neighbours of a bounded set of audit
queries, found by brute force, give the smallest number that reaches the
target recall (0.97 over 0.9 wanted).

Equal vectors collapse into classes that keep their few smallest keys, so
groups of copies cost one search and one candidate. Trees are cut into groups
by prefix, and groups that are still large by a hash, so a task holds a
bounded part of one tree's sorted array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinkframe.llm.common import written
from thinkframe.llm.vectors import cosine, element_type, lengths, matrix, packed_vectors, unit

TREES = 20
BITS = 48
GROUP_ROWS = 32_768  # strings of one tree that a task sorts at once
AUDIT_QUERIES = 128
TARGET = 0.97
STEP = 2  # levels climbed at once
MARGIN = 1e-9  # of a rough score; far over its rounding


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).normal(size=(TREES * BITS, dim)).astype(np.float32)


def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows x TREES) hash strings: BITS sign bits, the first is the highest of the long."""
    bits = (unit(x).astype(np.float32) @ planes.T > 0).reshape(len(x), TREES, BITS)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return (bits * weights).sum(axis=2, dtype=np.uint64).astype(np.int64)


def _with_strings(vectors: DataFrame, dim: int, kind: str, seed: int) -> DataFrame:
    """(rep, v, tree, code): one row per vector and tree."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                codes = strings(matrix(part.column(1).to_pylist(), kind), planes)
                n = len(codes)
                rows = pa.array(np.repeat(np.arange(n), TREES))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(codes.reshape(-1))], names=["rep", "v", "tree", "code"])

    return vectors.select("rep", "v").mapInArrow(hash_all, "rep long, v binary, tree int, code long")


def _brute_force(queries: pd.DataFrame, classes: DataFrame, kind: str, k: int) -> pd.DataFrame:
    """The exact ``k`` nearest other classes of each (bounded) query: (q, rep, v)."""
    shared = classes.sparkSession.sparkContext.broadcast((queries["rep"].to_numpy(), [bytes(v) for v in queries["v"]]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = shared.value
        own = unit(matrix(raw, kind))
        for batch in batches:
            reps, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            near = own @ unit(matrix(vectors, kind)).T
            near[names[:, None] == reps[None, :]] = -np.inf
            top = np.argsort(-near, axis=1)[:, :k]
            q = np.repeat(np.arange(len(names)), top.shape[1])
            at = top.reshape(-1)
            keep = near[q, at] > -np.inf
            q, at = q[keep], at[keep]
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(reps[at]), pa.array([vectors[i] for i in at], pa.binary()), pa.array(near[q, at])], names=["q", "rep", "v", "score"])

    found = classes.select("rep", "v").mapInArrow(nearest, "q long, rep long, v binary, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "rep")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "rep", "v").toPandas()


def _grouped(coded: DataFrame, base: int, sizes: DataFrame | None, side: str) -> DataFrame:
    """``bucket`` and ``salt`` of each string; queries go to every salt of their bucket."""
    out = coded.withColumn("bucket", F.shiftrightunsigned("code", BITS - base) if base else F.lit(0).cast("long"))
    out = out.join(sizes, ["tree", "bucket"])
    if side == "index":
        return out.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).drop("salts")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int")))).drop("salts")


def _ranges(codes: np.ndarray, own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the sorted ``codes`` that shares ``level`` first bits with each of ``own``."""
    shift = (BITS - level).astype(np.int64)
    low = (own >> shift) << shift
    return np.searchsorted(codes, low, side="left"), np.searchsorted(codes, low + (np.int64(1) << shift) - 1, side="right")


def nearest(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> tuple[DataFrame, dict]:
    """((query_id, rank, vec_id, score) of each query's ``k`` nearest, report).

    Queries are the keys for which ``is_query`` holds; candidates all other
    keys with a vector of the query's length. Nearness is the cosine in double
    precision; ties go to the smaller key. Vectors that are null, empty, zero
    or hold null or non-finite components, and null keys take no part; repeated
    keys count once. With fewer candidates than ``k``, all found are returned;
    without queries, none. The report holds, of the length that the audit
    found least of, the audit's recall, the level range and the number of
    candidates it settled on.
    """
    spark, kind = df.sparkSession, element_type(df, vector)
    packed = packed_vectors(df, key, vector).where("v IS NOT NULL")
    asked = df.where(is_query).select(F.col(key).cast("long").alias("id")).distinct().withColumn("asked", F.lit(True))
    vectors = written(packed.join(asked, "id", "left"), "vectors")
    found, reports = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), []
    own = lengths(vectors)
    for n in own:
        some, report = _nearest(vectors if len(own) == 1 else vectors.where(F.length("v") == n), k, kind, n, seed)
        found, reports = found.union(some), [*reports, report]
    return found, min(reports, key=lambda r: r["recall"], default={"recall": 1.0, "base": 0, "candidates": 0, "audited": 0})


def _nearest(vectors: DataFrame, k: int, kind: str, length: int, seed: int) -> tuple[DataFrame, dict]:
    """``nearest`` of (id, v, asked) with vectors of one length."""
    spark = vectors.sparkSession
    first = Window.partitionBy("v").orderBy("id")
    few = vectors.select("id", "v").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = written(few.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    n = classes.count()
    named = written(vectors.where("asked").select(F.col("id").alias("query_id"), "v").join(classes.select("v", "rep"), "v").select("query_id", "rep"), "queries")
    queries = classes.join(named.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    audit = queries.orderBy(F.xxhash64("rep")).limit(AUDIT_QUERIES).toPandas()
    report = {"recall": 1.0, "base": 0, "candidates": 0, "audited": len(audit)}
    if not len(audit):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), report
    dim = length // (4 if kind == "<f4" else 8)

    # how deep the audit queries' true neighbours share a prefix in some tree
    truth = _brute_force(audit, classes, kind, k)
    planes = _planes(dim, seed)
    own = dict(zip(audit["rep"], strings(matrix(audit["v"], kind), planes), strict=True))
    if len(truth):
        apart = np.stack([own[q] for q in truth["q"]]) ^ strings(matrix(truth["v"], kind), planes)
        depth = BITS - np.ceil(np.log2(apart.astype(np.float64) + 1)).astype(int).min(axis=1)
    else:
        depth = np.zeros(0, int)
    reached = [np.mean(depth >= x) if len(depth) else 1.0 for x in range(BITS + 1)]
    base = min(max(0, int(np.ceil(np.log2(max(1, n / GROUP_ROWS))))), max(x for x in range(BITS + 1) if reached[x] >= TARGET or x == 0))

    index = written(_with_strings(classes, dim, kind, seed), "forest")
    asking = written(_with_strings(queries, dim, kind, seed), "query-strings")
    bucket = F.shiftrightunsigned("code", BITS - base) if base else F.lit(0).cast("long")
    sizes = written(index.groupBy("tree", bucket.alias("bucket")).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("salts")), "buckets")
    group = ["tree", "bucket", "salt"]
    levels = list(range(base, min(BITS, base + 24) + 1, STEP))

    def count(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        codes, mine = np.sort(there["code"].to_numpy()), here["code"].to_numpy()
        out = {"rep": here["rep"].to_numpy()}
        for i, x in enumerate(levels):
            low, high = _ranges(codes, mine, np.full(len(mine), x, np.int64))
            out[f"c{i}"] = high - low
        return pd.DataFrame(out)

    counted = _grouped(index.drop("v"), base, sizes, "index").groupBy(group).cogroup(_grouped(asking.drop("v"), base, sizes, "query").groupBy(group))
    counts = counted.applyInPandas(count, "rep long, " + ", ".join(f"c{i} long" for i in range(len(levels))))
    counts = written(counts.groupBy("rep").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(levels))]), "prefix-counts")

    # the smallest number of candidates with which the audit reaches its target
    seen = counts.where(F.col("rep").isin([int(q) for q in audit["rep"]])).toPandas().set_index("rep")
    wanted, recall = float("inf"), reached[base]
    if len(truth):
        under = seen.loc[truth["q"], [f"c{i}" for i in range(len(levels))]].to_numpy()
        for m in 2 ** np.arange(6, 63):
            at = np.where(under >= m, np.array(levels), base).max(axis=1)
            if (share := np.mean(depth >= at)) >= TARGET or (under[:, 0] < m).all():
                wanted, recall = float(m), float(share)
                break
    report |= {"recall": float(recall), "base": base, "candidates": wanted}
    level = F.greatest(*[F.when(F.col(f"c{i}") >= wanted, F.lit(x)).otherwise(base) for i, x in enumerate(levels)], F.lit(base)).cast("long")
    asking = asking.join(counts.select("rep", level.alias("level")), "rep")
    most = k + 1  # the query's own class besides

    def search(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        """The ``most`` nearest classes of each query, exactly scored: every
        class within a margin of the last rough score takes part, so ties do
        not depend on rounding."""
        empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(there) or not len(here):
            return empty
        there = there.sort_values("code", ignore_index=True)
        raw, reps = matrix(there["v"], kind), there["rep"].to_numpy()
        x = unit(raw)
        low, high = _ranges(there["code"].to_numpy(), here["code"].to_numpy(), here["level"].to_numpy())
        asked_raw, found = matrix(here["v"], kind), []
        asked = unit(asked_raw)
        for i, (a, b) in enumerate(zip(low, high, strict=True)):
            near = x[a:b] @ asked[i]
            top = np.flatnonzero(near >= np.partition(near, -most)[-most] - MARGIN) if len(near) > most else np.arange(len(near))
            score = cosine(raw[a + top], np.broadcast_to(asked_raw[i], (len(top), raw.shape[1])))
            best = np.lexsort((reps[a + top], -score))[:most]
            found.append(pd.DataFrame({"q": here["rep"].iloc[i], "rep": reps[a + top[best]], "score": score[best]}))
        return pd.concat(found, ignore_index=True) if found else empty

    paired = _grouped(index, base, sizes, "index").groupBy(group).cogroup(_grouped(asking, base, sizes, "query").groupBy(group))
    found = paired.applyInPandas(search, "q long, rep long, score double").dropDuplicates(["q", "rep"])
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "rep")
    scored = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).drop("r")
    listed = scored.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    out = named.join(listed, named["rep"] == listed["q"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("r"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), report
