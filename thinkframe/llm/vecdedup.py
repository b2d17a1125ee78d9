"""Near duplicates of vectors through a robust-pruned flat graph.

1. Equal vectors collapse into weighted classes.
2. Centroids of a bounded sample deal the classes into overlapping shards:
   each class joins its ``overlap`` nearest centroids; the nearest is its home.
   So a pair is compared if either end joins the other's home.
3. Each shard builds a graph: every member's nearest others, pruned robustly
   (a neighbour goes if a kept one is ``ALPHA`` times nearer to it), so lists
   stay short yet reach far. Adjacency lists of the shards are united.
4. Every class searches its home shard: greedily from the shard's medoid over
   the united graph, then expanding the range: from whatever lies within reach
   of the threshold to all their neighbours, until nothing new is in reach.
   By the pruning rule a vector in range is reached through vectors whose
   distance is at most 1 + 1/ALPHA^2 times the range.
5. What is found is verified in double precision on the original vectors. A
   task returns one count and one link per class, never pairs; a link that
   only one end's home can show counts for the other end too. Components come
   from the links.
6. An audit compares counts with brute force, class by class. It draws until
   ``AUDITED`` classes with few links are in it (from about ``DRAWN`` at most) and
   holds them apart from those with many; if either kind misses more than 1 in
   100, the overlap is doubled and the graph built again. Where too few linked
   classes turn up to tell, it is doubled until that brings no more links.

Shards that hold more than ``BLOCK`` members are cut into hash blocks (cut
differently in each shard), each with a graph and medoid of its own, and
searched block by block, from the medoid and from what the query's own list
names there, so that a group of near copies of any size needs bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import written
from thinkframe.llm.components import connected_components
from thinkframe.llm.sampling import fitted, kept_share
from thinkframe.llm.vectors import cosine, element_type, lengths, matrix, packed_vectors, unit

SHARD = 1024  # classes per centroid, about
SAMPLE = 16_384  # expected classes the centroids are fitted on, at most
BLOCK = 8192  # members of a shard that a task holds at once
OVERLAP = 4
POOL, DEGREE, ALPHA = 48, 24, 1.2
AUDITED = 256  # linked classes of a kind that the audit compares
DRAWN = 16_384  # expected classes drawn to find them, at most: about the work of building the graph
FEW = 16  # links of a class that is not in a large group


def _centroids(sample: DataFrame, count: int, kind: str) -> np.ndarray:
    """Unit centroids: spread over the sample by a few rounds of spherical k-means."""

    def fit(frame: pd.DataFrame) -> bytes:
        x = unit(matrix(frame.sort_values("rep")["v"], kind)).astype(np.float32)
        rng = np.random.Generator(np.random.PCG64(13))
        c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
        for _ in range(4):
            near = np.concatenate([(x[at : at + 2048] @ c.T).argmax(axis=1) for at in range(0, len(x), 2048)])
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
        return c.astype("<f4").tobytes()

    raw = fitted(sample, fit)
    width = len(sample.first()["v"]) // (4 if kind == "<f4" else 8)
    return np.frombuffer(raw, "<f4").reshape(-1, width)


def _members(classes: DataFrame, centroids: np.ndarray, overlap: int, kind: str) -> DataFrame:
    """(rep, weight, v, shard, home, joined): a row per class and shard it
    joins; ``joined`` lists them all, the home first."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        k = min(overlap, len(c))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = unit(matrix(part.column(2).to_pylist(), kind)).astype(np.float32) @ c.T
                top = np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)
                rows = pa.array(np.repeat(np.arange(len(top)), k))
                home = pa.array(np.tile(np.arange(k) == 0, len(top)))
                joined = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1) * k, pa.int32()), pa.array(top.reshape(-1))).take(rows)
                columns = [*[part.column(i).take(rows) for i in range(3)], pa.array(top.reshape(-1)), home, joined]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "weight", "v", "shard", "home", "joined"])

    return classes.select("rep", "weight", "v").mapInArrow(deal, "rep long, weight long, v binary, shard int, home boolean, joined array<int>")


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists (row numbers) of unit rows: nearest POOL, robustly pruned to DEGREE."""
    n, pool = len(x), min(POOL, len(x) - 1)
    lists: list[np.ndarray] = []
    if pool < 1:
        return [np.zeros(0, np.int64)] * n
    x = x.astype(np.float32)
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        order = np.argsort(-np.take_along_axis(near, cand, axis=1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, axis=1)
        own = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(near, cand, axis=1)))
        y = x[cand]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("npd,nqd->npq", y, y, optimize=True)))
        alive, kept = np.ones(cand.shape, bool), np.zeros(cand.shape, bool)
        every = np.arange(len(rows))
        for _ in range(min(DEGREE, pool)):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            kept[every[some], first[some]] = True
            alive[every, first] = False
            alive &= ~((ALPHA * between[every, first] <= own) & some[:, None])
        lists += [c[k] for c, k in zip(cand, kept, strict=True)]
    return lists


def _both_ways(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, neighbours) of the lists and their reverses."""
    src = np.repeat(np.arange(n), [len(a) for a in lists])
    dst = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % max(1, n)


def _neighbours(bounds: np.ndarray, flat: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    sizes = bounds[nodes + 1] - bounds[nodes]
    at = np.repeat(bounds[nodes] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return np.unique(flat[at])


def range_search(queries: np.ndarray, own: np.ndarray, known: list[np.ndarray], x: np.ndarray, bounds: np.ndarray, flat: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows of ``x`` with a cosine of about ``least`` or more), for the
    queries that have any. ``own``: a query's own row, or -1; ``known``: rows
    that its adjacency list names."""
    reach = np.sqrt(2 - 2 * least) * (1 + 1 / ALPHA**2)
    slack = 1 - min(reach, 2.0) ** 2 / 2
    medoid = int((x @ x.mean(axis=0)).argmax())
    degree = np.diff(bounds)
    wide = max(1, int(degree.max(initial=0)))
    for at in range(0, len(queries), 256):
        q, mine = queries[at : at + 256], own[at : at + 256]
        now = np.full(len(q), medoid)
        score = q @ x[medoid]
        moving = np.arange(len(q))
        while len(moving):  # greedy: to the best neighbour, as long as one is better
            spread = np.arange(min(wide, int(degree[now[moving]].max(initial=0))))
            if not len(spread):
                break
            inside = spread[None, :] < degree[now[moving]][:, None]
            nodes = np.where(inside, flat[np.minimum(bounds[now[moving]][:, None] + spread, len(flat) - 1)], now[moving][:, None])
            near = np.einsum("nkd,nd->nk", x[nodes], q[moving], optimize=True)
            best = near.argmax(axis=1)
            value = near[np.arange(len(moving)), best]
            better = value > score[moving] + 1e-7
            moving, best, value = moving[better], nodes[np.arange(len(best)), best][better], value[better]
            now[moving], score[moving] = best, value
        for i in range(len(q)):
            start = np.unique(np.concatenate([[now[i]], [mine[i]] if mine[i] >= 0 else known[at + i]]).astype(np.int64))
            front = np.union1d(start, _neighbours(bounds, flat, start))
            near = x[front] @ q[i]
            seen, found = front, [front[near >= least]]
            front = front[near >= slack]
            while len(front):
                front = np.setdiff1d(_neighbours(bounds, flat, front), seen, assume_unique=True)
                near = x[front] @ q[i]
                seen = np.union1d(seen, front)
                found.append(front[near >= least])
                front = front[near >= slack]
            rows = np.concatenate(found)
            rows = rows[rows != mine[i]]
            if len(rows):
                yield at + i, rows


def _links(classes: DataFrame, centroids: np.ndarray, overlap: int, least: float, kind: str) -> DataFrame:
    """(rep, links, root): found link weights and one component link per class and task."""
    members = written(_members(classes, centroids, overlap, kind), "shards")
    blocks = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = members.join(written(blocks, "blocks"), "shard").withColumn("block", F.pmod(F.xxhash64("rep", "shard"), F.col("blocks")).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", ignore_index=True)
        reps = frame["rep"].to_numpy(np.int64)
        lists = pruned_graph(unit(matrix(frame["v"], kind)))
        return pd.DataFrame({"rep": reps, "near": [reps[a] for a in lists]})

    lists = members.select("shard", "block", "rep", "v").groupBy("shard", "block").applyInPandas(build, "rep long, near array<long>")
    united = written(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    there = members.join(united, "rep").select("shard", F.explode(numbers).alias("asking"), "block", "rep", "weight", "v", "near", F.col("joined")[0].alias("at_home"))
    here = members.where("home").join(united, "rep").select("shard", F.col("block").alias("asking"), F.explode(numbers).alias("block"), "rep", "weight", "v", "near", "joined")
    here = here.toDF("shard", "asking", "block", "q", "qw", "qv", "known", "joined")
    group = ["shard", "asking", "block"]

    def search(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(here):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        there, here = there.sort_values("rep", ignore_index=True), here.sort_values("q", ignore_index=True)
        reps, asked, weight = there["rep"].to_numpy(np.int64), here["q"].to_numpy(np.int64), there["weight"].to_numpy(np.int64)
        raw, raw_asked = matrix(there["v"], kind), matrix(here["qv"], kind)

        def places(ids: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(reps, ids), len(reps) - 1)
            return at[reps[at] == ids]

        lists, known = [places(x) for x in there["near"]], [places(x) for x in here["known"]]
        bounds, flat = _both_ways(lists, len(reps))
        own = np.minimum(np.searchsorted(reps, asked), len(reps) - 1)
        own = np.where(reps[own] == asked, own, -1)
        nodes = np.union1d(reps, asked)
        label, place, mine = np.arange(len(nodes)), np.searchsorted(nodes, reps), np.searchsorted(nodes, asked)
        links, at_home = np.zeros(len(nodes), np.int64), there["at_home"].to_numpy(np.int64)
        asked_weight, joined = here["qw"].to_numpy(np.int64), [np.asarray(x) for x in here["joined"]]
        for i, rows in range_search(unit(raw_asked), own, known, unit(raw), bounds, flat, least - 1e-9):
            rows = rows[cosine(np.broadcast_to(raw_asked[i], (len(rows), raw.shape[1])), raw[rows]) >= least]
            links[mine[i]] += weight[rows].sum()
            links[place[rows[~np.isin(at_home[rows], joined[i])]]] += asked_weight[i]  # their homes do not hold the asking one
            old = np.unique(label[np.append(place[rows], mine[i])])
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
        out = pd.DataFrame({"rep": nodes, "links": links, "root": nodes[label]})
        return out[(out["links"] > 0) | (out["rep"] != out["root"])]

    return there.groupBy(group).cogroup(here.groupBy(group)).applyInPandas(search, "rep long, links long, root long")


def _truth(sample: pd.DataFrame, classes: DataFrame, least: float, kind: str) -> dict[int, int]:
    """True link weights of a bounded sample's linked classes, by brute force."""
    shared = classes.sparkSession.sparkContext.broadcast((sample["rep"].to_numpy(np.int64), [bytes(v) for v in sample["v"]]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = shared.value
        mine, total = unit(matrix(raw, kind)), np.zeros(len(names), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                other, reps, weight = unit(matrix(part.column(2).to_pylist(), kind)), part.column(0).to_numpy(), part.column(1).to_numpy()
                for i in range(0, len(names), 1024):
                    p, q = np.nonzero(mine[i : i + 1024] @ other.T >= least)
                    p, q = p[names[i + p] != reps[q]], q[names[i + p] != reps[q]]
                    np.add.at(total, i + p, weight[q])
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(total[some])], names=["rep", "links"])

    found = classes.select("rep", "weight", "v").mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    return {r["rep"]: r["links"] for r in found.collect()}


def _audited(classes: DataFrame, n: int, least: float, kind: str) -> tuple[dict[int, int], bool]:
    """(true link weights of up to ``AUDITED`` classes with few links and as
    many with more, whether they are enough to tell): classes are drawn by hash
    until enough with few links are there or the draw of about ``DRAWN`` ends."""
    share = min(1.0, DRAWN / n)
    drawn = classes.where(kept_share(F.col("rep"), share, 29)).select("rep", "v", F.xxhash64(F.lit(31), "rep").alias("h")).toPandas()
    drawn = drawn.sort_values(["h", "rep"], ignore_index=True)
    few, many, at, step = {}, {}, 0, 4 * AUDITED
    while at < len(drawn) and len(few) < AUDITED:
        for rep, links in sorted(_truth(drawn[at : at + step], classes, least, kind).items()):
            kept = few if links < FEW else many
            if len(kept) < AUDITED:
                kept[rep] = links
        at, step = at + step, 4 * step
    return few | many, len(few) >= AUDITED or (share == 1.0 and at >= n)


def audit_recall(truth: dict[int, int], found: dict[int, int]) -> float | None:
    """Mean recall of classes with few links or of those with many, whichever
    is less; None where no class has links."""
    kinds = [[min(found.get(r, 0), t) / t for r, t in truth.items() if (t < FEW) == few] for few in (True, False)]
    return min((sum(x) / len(x) for x in kinds if x), default=None)


def near_duplicates(df: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict]:
    """((key, n_links, component_id, kept) per distinct key, report).

    Vectors of one length link when their cosine, in double precision, is
    ``least`` or more; vectors of different lengths have none. Vectors that are
    null, empty, zero or hold null or non-finite components, and null keys link
    with nothing; repeated keys count once. ``component_id`` is the smallest key
    reachable by links. Other columns are not read; an empty table gives an
    empty table. The report holds the audit's recall (None where no audited
    class has links; the least of all lengths) and the largest overlap it
    settled on.
    """
    kind = element_type(df, vector)
    vectors = written(packed_vectors(df, key, vector), "vectors")
    own = lengths(vectors)
    out = vectors.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    reports = []
    for n in own:
        some, report = _near_duplicates(vectors.where("v IS NOT NULL") if len(own) == 1 else vectors.where(F.length("v") == n), least, kind)
        out, reports = out.union(some), [*reports, report]
    out = out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    known = [r["recall"] for r in reports if r["recall"] is not None]
    return out, {"recall": min(known, default=None), "overlap": max((r["overlap"] for r in reports), default=0)}


def _near_duplicates(vectors: DataFrame, least: float, kind: str) -> tuple[DataFrame, dict]:
    """(id, n_links, component_id) of vectors (id, v) of one length, report."""
    classes = vectors.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = written(classes, "classes")
    n = classes.count()
    sample = written(classes.where(kept_share(F.col("rep"), min(1.0, SAMPLE / n), 23)).select("rep", "v"), "centroid-sample")
    if not sample.head(1):
        sample = classes.orderBy("rep").limit(1).select("rep", "v")
    centroids = _centroids(sample, min(SAMPLE, -(-n // SHARD)), kind)
    truth, enough = _audited(classes, n, least, kind)
    overlap, before = min(OVERLAP, len(centroids)), None
    while True:
        links = written(_links(classes, centroids, overlap, least, kind), "links")
        counts = links.where(F.col("rep").isin(list(truth))).groupBy("rep").agg(F.sum("links").alias("n")).collect() if truth else []
        recall = audit_recall(truth, {r["rep"]: r["n"] for r in counts})
        report = {"recall": recall, "overlap": overlap}
        total = None if enough else links.agg(F.sum("links")).first()[0] or 0
        if overlap >= len(centroids) or ((recall is None or recall >= 0.99) and (enough or total == before)):
            break
        before = total
        overlap = min(2 * overlap, len(centroids))
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(linked, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = vectors.select("id", "v").join(per_class, "v", "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")), report
