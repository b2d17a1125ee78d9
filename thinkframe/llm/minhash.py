"""Near duplicates by b-bit MinHash.

1. One pass hashes every text's distinct word shingles and takes the minima of
   ``BANDS * ROWS`` hash functions. Only the low ``BITS`` bits of each minimum
   are kept, packed into longs; bands of ``ROWS`` full minima become keys.
2. Texts with equal shingle sets collapse into one class, a node of its own
   whatever the keys of its texts.
3. Classes that share a band key are candidates. First every member
   of a key meets the key's smallest member only (a star). Candidates are
   estimated by counting equal lanes of the packed signatures, corrected for
   chance collisions; those within reach of the threshold are confirmed on
   full shingle sets. Confirmed links give components.
4. Keys of three or more members that are still in several components are
   searched for links across them: signatures first, then bitmaps of the sets
   (bits of one set that the other lacks bound the intersection from above, so
   no link is lost). A key lists the pairs that remain; where they are many
   times its members it yields a spanning forest of them instead. They are
   confirmed on full sets, components grow, refused pairs are noted, and the
   search repeats under the keys that gave forests. Keys still open after
   ``MAX_ROUNDS`` rounds get an exact end: every pair left across their
   components is compared on full sets, block pair by block pair in the tasks,
   which return links only.
   So no link between texts that share a key is lost, while a group of
   thousands of near copies moves thousands of pairs, not millions.

With 24 bands of 4 rows a pair at similarity 0.8 shares no key with
probability 3e-6 (less above); a pair is estimated too low for confirmation
only at five standard deviations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import FILTER_BITS, WordHasher, doc_chunks, key_bits, mix64, shingles, written
from thinkframe.llm.components import connected_components

BANDS, ROWS, BITS = 24, 4, 4
HASHES = BANDS * ROWS
LANES = 64 // BITS
LONGS = HASHES // LANES
BLOCK = 2048  # members of a band key compared at once
MAP_BITS = 1 << 15  # 4 KB: a block's bitmaps stay under 16 MB
LISTED = 4  # pairs per member that a key may list before it gives a spanning forest instead
MAX_ROUNDS = 4  # of spanning forests; what is open then is compared exactly
SET_BYTES = 1 << 24  # of full sets in a block that is compared exactly

SIGNATURE = [f"s{i}" for i in range(LONGS)]


class _Minima:
    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(7))
        self.mul = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)

    def of(self, values: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), 4096):
            h = values[at : at + 4096, None] * self.mul
            h += self.add
            np.minimum(least, h.min(axis=0), out=least)
        return least


def packed(minima: np.ndarray) -> np.ndarray:
    """(documents x HASHES) minima to (documents x LONGS) longs of low bits."""
    low = (mix64(minima) & np.uint64((1 << BITS) - 1)).reshape(len(minima), LONGS, LANES)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=2).view(np.int64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(documents x BANDS) keys of the full minima of each band."""
    rows = minima.reshape(len(minima), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(k, n_shingles, set_hash, s0.., bands) per row; texts without words have
    no set_hash, signature or bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minima = WordHasher(), _Minima()
        for batch in batches:
            for first, last, data, offsets in doc_chunks(batch.column(1)):
                hashes, bounds = hasher.documents(data, offsets)
                n = last - first
                sizes, digests, least = np.zeros(n, np.int64), [], np.zeros((n, HASHES), np.uint64)
                for i in range(n):
                    own = shingles(hashes[bounds[i] : bounds[i + 1]], words)
                    sizes[i] = len(own)
                    digests.append(digest(own.tobytes()) if len(own) else None)
                    if len(own):
                        least[i] = minima.of(own)
                none = sizes == 0
                lanes = packed(least)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(band_keys(least).reshape(-1)), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(sizes), pa.array(digests, pa.binary()), *[pa.array(lanes[:, j], mask=none) for j in range(LONGS)], keys],
                    names=["k", "n_shingles", "set_hash", *SIGNATURE, "bands"],
                )

    schema = "k long, n_shingles long, set_hash binary, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", bands array<long>"
    return docs.select(F.col(key).cast("long"), F.col(text)).toDF("k", "t").mapInArrow(sign, schema)


def digest(shingle_set: bytes) -> bytes:
    return hashlib.blake2b(shingle_set, digest_size=16).digest()


def shingle_sets(source: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(k, n, shingle_set, map) of the wanted classes ``ids`` (k, rep, set_hash)
    of ``source`` (k, t): sorted distinct 64-bit shingle hashes as bytes, their
    number and their bitmap, from the texts with the class's key. Texts do not
    move: rows whose key is surely not wanted are dropped where they are read."""
    shared = source.sparkSession.sparkContext.broadcast(key_bits(ids, "rep"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = WordHasher(), shared.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for first, last, data, offsets in doc_chunks(batch.column(1)):
                hashes, bounds = hasher.documents(data, offsets)
                own = [shingles(hashes[bounds[i] : bounds[i + 1]], words).tobytes() for i in range(last - first)]
                sizes = pa.array([len(x) // 8 for x in own], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(map(digest, own), pa.binary()), sizes, pa.array(own, pa.binary()), pa.array(map(bitmap, own), pa.binary())],
                    names=["rep", "set_hash", "n", "shingle_set", "map"],
                )

    keyed = source.where("k IS NOT NULL").select("k", "t", F.pmod(F.xxhash64("k"), F.lit(FILTER_BITS)).alias("place"))
    found = keyed.mapInArrow(sets, "rep long, set_hash binary, n long, shingle_set binary, map binary")
    return found.join(ids.select("k", "rep", "set_hash"), ["rep", "set_hash"]).select("k", "n", "shingle_set", "map")


def bitmap(shingle_set: bytes) -> bytes:
    """16 to 32 bits per shingle (a power of two from 256 to MAP_BITS), set at the
    hashes' low bits; larger sets only make the bound looser."""
    values = np.frombuffer(shingle_set, np.uint64)
    size = min(MAP_BITS, max(256, 16 << max(0, len(values) - 1).bit_length()))
    at = np.unique(values & np.uint64(size - 1)).astype(np.int64)
    out = np.zeros(size // 64, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.tobytes()


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def possible(sizes: np.ndarray, maps: list[np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of rows p and q can link, by their bitmaps: shingles of
    one set whose bit the other lacks are not shared."""
    width = np.array([len(m) for m in maps])
    out = np.zeros(len(p), bool)
    wide = int(width.max(initial=0)) + 1
    kinds = width[p] * wide + width[q]
    for kind in np.unique(kinds):
        pair = divmod(int(kind), wide)
        words, own = min(pair), np.flatnonzero(kinds == kind)
        side = []
        for rows in (p[own], q[own]):
            used, at = np.unique(rows, return_inverse=True)
            side.append((_folded(np.stack([maps[r] for r in used]), words), at, sizes[rows]))
        (x, xa, nx), (y, ya, ny) = side
        cx, cy = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
        step = max(1, (1 << 19) // words)
        for at in range(0, len(own), step):
            a, b = xa[at : at + step], ya[at : at + step]
            both = np.bitwise_count(x[a] & y[b]).sum(axis=1, dtype=np.int64)
            most = np.minimum(nx[at : at + step] - (cx[a] - both), ny[at : at + step] - (cy[b] - both))
            out[own[at : at + step]] = 100 * most >= percent * (nx[at : at + step] + ny[at : at + step] - most)
    return out


def equal_lanes(left: str, right: str) -> Column:
    """Lanes that two packed signatures (columns left.s0.., right.s0..) share."""
    lanes = int("".join("0" * (BITS - 1) + "1" for _ in range(LANES)), 2)
    other = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        other = other + F.bit_count(folded.bitwiseAND(F.lit(lanes)))
    return F.lit(HASHES) - other


def estimate(equal: Column) -> Column:
    """Similarity from equal lanes, corrected for collisions of low bits."""
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def _least_equal(percent: int) -> int:
    """Equal lanes below which a pair at the threshold is five deviations off."""
    s = percent / 100
    p = s + (1 - s) / (1 << BITS)
    return int(np.floor(HASHES * p - 5 * np.sqrt(HASHES * p * (1 - p))))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("k").alias("a"), F.col("shingle_set").alias("x"))
    right = sets.select(F.col("k").alias("b"), F.col("shingle_set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def _near(pairs: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """Distinct pairs whose signatures share ``least`` lanes or more."""
    with_a = pairs.distinct().join(signed.select(F.col("k").alias("a"), F.struct(*SIGNATURE).alias("l")), "a")
    with_b = with_a.join(signed.select(F.col("k").alias("b"), F.struct(*SIGNATURE).alias("r")), "b")
    return with_b.where(equal_lanes("l", "r") >= least).select("a", "b")


def forest(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Numbers of pairs (p, q) that connect what all of them connect: in each
    round every component takes one pair to another component."""
    label, taken = label.copy(), []
    left = np.arange(len(p))
    while len(left := left[label[p[left]] != label[q[left]]]):
        ends = np.concatenate([label[p[left]], label[q[left]]])
        chosen = np.unique(np.tile(left, 2)[np.unique(ends, return_index=True)[1]])
        for i in chosen:
            x, y = label[p[i]], label[q[i]]
            if x != y:
                taken.append(i)
                label[label == max(x, y)] = min(x, y)
    return np.array(taken, np.int64)


def _linked(sizes: np.ndarray, sets: list[bytes], label: np.ndarray, pairs: Iterator[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Those of the pairs that link on full sets, without links inside what
    earlier ones put together: they connect what all of them connect."""
    label, links = label.copy(), []
    number = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1].astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = np.zeros(int(number.max(initial=-1)) + 1, bool)
    for part in pairs:
        for p in np.unique(part[:, 0]):
            mine = number[bounds[p] : bounds[p + 1]]
            own[mine] = True
            for q in part[part[:, 0] == p, 1]:
                if label[p] == label[q]:
                    continue
                both = int(np.count_nonzero(own[number[bounds[q] : bounds[q + 1]]]))
                if 100 * both >= percent * (sizes[p] + sizes[q] - both):
                    links.append((p, q))
                    label[label == label[q]] = label[p]
            own[mine] = False
    return links


def _across(members: DataFrame, lanes: DataFrame, maps: DataFrame, refused: DataFrame, least: int, percent: int, exact: bool = False) -> DataFrame:
    """Pairs (bucket, a, b, whole) to confirm across the components under each
    key of three or more members, hash blocks of large keys in pairs.

    ``whole``: the block's pairs are all there. That is so unless they are more
    than ``LISTED`` times its members; then they are a spanning forest.
    ``exact``: ``lanes`` has the bands and ``maps`` the full sets, and the pairs
    are links that connect what all links across the components connect. A
    pair is then compared under the first key it shares only: where that key
    is closed, the pair was tried before or lies in one component.
    """
    sizes = members.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi and m > 2")
    blocks = F.ceil(F.col("m") / BLOCK)
    if exact:
        held = members.join(maps.select("k", "n"), "k").groupBy("bucket").agg(F.sum("n").alias("held"))
        sizes, blocks = sizes.join(held, "bucket"), F.greatest(blocks, F.ceil(8 * F.col("held") / SET_BYTES))
    sizes = sizes.select("bucket", blocks.cast("int").alias("blocks"))
    no = refused.groupBy(F.col("a").alias("k")).agg(F.collect_list("b").alias("no"))
    rows = members.join(sizes, "bucket").join(lanes, "k").join(maps, "k").join(no, "k", "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "c", "n", "map", "no", *SIGNATURE, *(["bands", "shingle_set"] if exact else []))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k", ignore_index=True)
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        sig, k = frame[SIGNATURE].to_numpy(np.int64).view(np.uint64), frame["k"].to_numpy()
        sizes, maps = frame["n"].to_numpy(), [np.frombuffer(m, np.uint64) for m in frame["map"]]
        ones = np.uint64(int("".join("0" * (BITS - 1) + "1" for _ in range(LANES)), 2))
        label = np.unique(frame["c"].to_numpy(), return_inverse=True)[1]
        main = label == np.bincount(label).argmax()  # no pair within the largest component is looked at
        refused = [(np.full(len(bs), a), np.searchsorted(k, bs), bs) for a, bs in enumerate(frame["no"]) if bs is not None]
        no = np.zeros(0, np.int64)
        if refused:
            ends, at, others = (np.concatenate(x) for x in zip(*refused, strict=True))
            at = np.minimum(at, len(k) - 1)
            no = (ends * len(k) + at)[k[at] == others]

        def near(left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                unequal = np.zeros((len(rows), len(right)), np.int16)
                for t in range(LONGS):
                    x = sig[rows, t][:, None] ^ sig[right, t][None, :]
                    folded = x
                    for shift in range(1, BITS):
                        folded = folded | (x >> np.uint64(shift))
                    unequal += np.bitwise_count(folded & ones)
                p, q = np.nonzero((HASHES - unequal >= least) & (label[rows][:, None] != label[right][None, :]))
                p, q = np.maximum(rows[p], right[q]), np.minimum(rows[p], right[q])
                if len(no):
                    fresh = ~np.isin(p * len(k) + q, no)
                    p, q = p[fresh], q[fresh]
                if exact:
                    same = bands[p] == bands[q]
                    first = bands[p, same.argmax(axis=1)] == bucket
                    p, q = p[first], q[first]
                good = possible(sizes, maps, p, q, percent)
                yield np.stack([p[good], q[good]], axis=1)

        own = frame["own"].to_numpy()
        here, there = own == i, own == j
        parts = [(here & ~main, there)] if i == j else [(here & ~main, there), (here & main, there & ~main)]
        found, whole, bucket = np.zeros((0, 2), np.int64), True, frame["bucket"].iloc[0]
        if exact:
            bands = np.stack(frame["bands"].to_list())
            pairs = (x for left, right in parts for x in near(np.flatnonzero(left), np.flatnonzero(right)))
            found = np.array(_linked(sizes, frame["shingle_set"].to_list(), label, pairs, percent), np.int64).reshape(-1, 2)
            parts = []
        for left, right in parts:
            for pairs in near(np.flatnonzero(left), np.flatnonzero(right)):
                found = np.unique(np.concatenate([found, pairs]), axis=0)
                if len(found) > LISTED * len(k):
                    found, whole = found[forest(label, found[:, 0], found[:, 1])], False
        ends = k[found]
        return pd.DataFrame({"bucket": bucket, "a": ends[:, 0], "b": ends[:, 1], "whole": whole})

    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "bucket long, a long, b long, whole boolean")


def _keyed(signed: DataFrame, classes: DataFrame, last: DataFrame) -> DataFrame:
    """(k, n_shingles, component_id) of the signed rows: the smallest key that
    links of classes, and rows that share a key, reach."""
    named = classes.select("set_hash", "rep", "k").join(last, F.col("k") == F.col("node"), "left")
    named = written(named.select("set_hash", "rep", F.coalesce("component", "k").alias("c")), "class-components")
    least = named.groupBy("c").agg(F.min("rep").alias("m"))
    rows = signed.select("k", "n_shingles", "set_hash").join(named.join(least, "c").select("set_hash", "m"), "set_hash", "left")
    out = rows.select("k", "n_shingles", F.when(F.col("k").isNotNull(), F.coalesce("m", "k")).alias("m"))
    repeated = signed.where("k IS NOT NULL").groupBy("k").count().where("count > 1").select("k")
    if not repeated.head(1):
        return out.withColumnRenamed("m", "component_id")
    out = written(out, "row-components")
    joined = connected_components(out.join(repeated, "k", "left_semi"), "k", "m")
    return out.join(joined, F.col("m") == F.col("node"), "left").select("k", "n_shingles", F.coalesce("component", "m").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased. Texts link when
    100 * |A & B| >= percent * |A | B| over their distinct ``words``-word
    shingles; a text with fewer words has one shingle, its whole sequence.
    Null and wordless texts have no shingles and link with nothing. Rows with
    equal keys are one node, whose links are those of all its texts; each row
    keeps the size of its own set, and all of a key's rows have its component.
    A null key links with nothing, gives a null component and is kept. Ties go
    to the smallest key; an empty table gives an empty table. Other columns are
    not read. Results do not depend on partitioning.
    """
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    signed = written(signatures(source, "k", "t", words), "signatures")
    sets = signed.where("set_hash IS NOT NULL AND k IS NOT NULL")
    classes = sets.groupBy("set_hash").agg(F.min("k").alias("rep"), F.min_by(F.struct(*SIGNATURE, "bands"), "k").alias("v"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("k"), "set_hash", "rep", "v.*"), "classes")
    rows = classes.select("k", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("k").alias("hub"), F.max("k").alias("top")).where("hub <> top").select("bucket", "hub")
    members = written(rows.join(hubs, "bucket"), "members")
    lanes = classes.select("k", *SIGNATURE)
    least = _least_equal(percent)

    star = members.where("k <> hub").select(F.col("k").alias("a"), F.col("hub").alias("b"))
    near = written(_near(star, lanes, least), "star")
    several = members.groupBy("bucket").count().where("count > 2").select("bucket")
    several = members.select("bucket", "k").join(several, "bucket")
    ids = near.select(F.explode(F.array("a", "b")).alias("k")).union(several.select("k")).distinct()
    sets = written(shingle_sets(source, classes.join(ids, "k", "left_semi"), words), "sets")
    maps = sets.select("k", "n", "map").dropDuplicates(["k"])
    tries = near.count()
    links = written(_confirmed(near, sets, percent), "links", tries)
    refused = near.join(links, ["a", "b"], "left_anti")
    last = connected_components(links, rows=tries)
    for turn in range(MAX_ROUNDS + 1):
        labelled = several.join(last, F.col("k") == F.col("node"), "left").select("bucket", "k", F.coalesce("component", "k").alias("c"))
        known = last.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if turn == MAX_ROUNDS:
            more = _across(labelled, classes.select("k", "bands", *SIGNATURE), sets.dropDuplicates(["k"]), refused, least, percent, exact=True)
            more = written(more.select("a", "b").distinct(), "links")
            last = connected_components(known.union(more))
            break
        tried = written(_across(labelled, lanes, maps, refused, least, percent), "across")
        tries += tried.count()
        pairs = tried.select("a", "b").distinct()
        more = written(_confirmed(pairs, sets, percent), "links", tries)
        last = connected_components(known.union(more), rows=2 * tries)
        again = tried.where("not whole").select("bucket").distinct()
        if not again.head(1):
            break
        refused = written(refused.union(pairs.join(more, ["a", "b"], "left_anti")), "refused", tries)
        several = written(several.join(again, "bucket", "left_semi"), "open-keys")

    out = _keyed(signed, classes, last)
    return out.select(F.col("k").alias(key), "n_shingles", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
