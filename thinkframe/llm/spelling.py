"""Spelling variants by k-d trees over letter counts.

1. One pass counts the words of the texts: distinct runs per document, summed
   in each task, then over all tasks.
2. A word is a point: how often it holds each letter. One inserted, deleted or
   replaced letter moves it by at most two: one count up, one down, or both.
   So a word's near words lie, among words of its length, in the box of points
   one up and one down from it, and, among words one letter longer, one up.
3. A top k-d tree per length, fitted on a bounded sample, cuts the points into
   cells. A word goes to its own cell as a member and, as a visitor, to every
   cell of its own and the next length whose box its reach meets.
4. A task builds a cell's k-d tree to leaves of ``LEAF`` words and lets its
   visitors descend together, box by box; in a leaf the order of letters
   decides. It returns a row per word it found a near word for, never pairs.

Cells far over their share (the sample only guides) are split by hash into
blocks of members and visitors, every block of one meeting every one of the
other, so no task holds more than it should.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinkframe.llm.common import mix64, written

RUN = re.compile("[a-zÀ-ÿ]+")  # of texts whose A-Z are lower-cased
LETTERS = 26 + 64
HELD_WORDS = 1 << 17  # counted in a task before they are handed on
PIECE = 1 << 20  # characters of a text tokenised at once
SAMPLE = 1 << 17  # words the top trees are fitted on (expected)
LEAST_SAMPLE = 32  # sampled words below which a cell is not cut further
CELL = 1 << 15  # words a cell should have
BLOCK_BYTES = 1 << 21  # of members' letters in a block
VISITORS = 1 << 20  # in a block
LEAF = 32
TREE_LENGTH = 64  # longer words have a cell per length
BATCH = 1 << 15  # visitors that descend together

_DIMENSION = np.full(256, LETTERS, np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[0xC0:0x100] = np.arange(26, LETTERS)


# ---- words -----------------------------------------------------------------


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that cut no run."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text) and RUN.match(text, end) and RUN.match(text, end - 1):
            end = RUN.match(text, end).end()
        yield text[at:end]
        at = end


def counted_words(docs: DataFrame, key: str, text: str, least_length: int, one_in: int) -> DataFrame:
    """(word, n): words of ``least_length`` letters or more with their
    occurrences, after each document's altered runs (see ``variants``)."""

    long_run = re.compile(f"{RUN.pattern[:-1]}{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                if not raw:
                    continue
                runs: Counter[str] = Counter()
                for piece in pieces(raw.lower().decode()):  # of bytes: A-Z only
                    runs.update(long_run.findall(piece))
                start = zlib.crc32(f"{'' if keys[i].as_py() is None else keys[i].as_py()}:".encode())
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if one_in and h % one_in == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] += n
                if len(total) > HELD_WORDS:
                    yield flushed()
        if total:
            yield flushed()

    words = docs.select(F.col(key).cast("long"), F.col(text)).toDF("k", "t").mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


# ---- points and trees ------------------------------------------------------


def letters(words: pa.Array) -> list[bytes]:
    """One byte per letter (all are in Latin-1, whose order is that of code points)."""
    return [w.encode("latin-1") for w in words.to_pylist()]


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """(words x LETTERS) counts of a (words x length) array of letters."""
    n, length = codes.shape
    out = np.zeros((n, LETTERS), np.uint8 if length < 256 else np.int32)
    step = max(1, (1 << 22) // max(1, length))
    for at in range(0, n, step):
        rows = codes[at : at + step]
        place = _DIMENSION[rows] + np.arange(len(rows))[:, None] * LETTERS
        out[at : at + step] = np.bincount(place.reshape(-1), minlength=len(rows) * LETTERS).reshape(-1, LETTERS)
    return out


def widest(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, bound): the cut at most ``bound`` against more that parts the
    points most evenly; None if they are all alike."""
    n, best = len(points), None
    low, high = points.min(axis=0), points.max(axis=0)
    dims = np.flatnonzero(high > low)
    own = points[:, dims]
    for bound in np.unique(own) if len(dims) else ():
        more = np.count_nonzero(own > bound, axis=0)
        even = np.minimum(more, n - more)
        at = int(even.argmax())
        if even[at] and (best is None or even[at] > best[0]):
            best = (int(even[at]), int(dims[at]), int(bound))
        elif best and even[at] < best[0] and more.max() < n // 2:
            break  # higher bounds part less
    return best and best[1:]


class Tree:
    """A k-d tree: node i is a leaf (``dim`` -1, ``number`` its number) or cuts
    ``dim`` into at most ``bound`` (child ``left``) and more (``left + 1``)."""

    def __init__(self, points: np.ndarray, most: int):
        self.dim, self.bound, self.left, self.number, self.rows = [-1], [0], [-1], [0], []
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            cut = widest(points[own]) if len(own) > most else None
            if cut is None:
                self.number[node] = len(self.rows)
                self.rows.append(own)
                continue
            self.dim[node], self.bound[node], self.left[node] = cut[0], cut[1], len(self.dim)
            for _ in range(2):
                self.dim.append(-1)
                self.bound.append(0)
                self.left.append(-1)
                self.number.append(-1)
            low = points[own, cut[0]] <= cut[1]
            todo += [(self.left[node], own[low]), (self.left[node] + 1, own[~low])]

    def reached(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``points`` whose reach meets the leaf's box): boxes that
        lie at most ``up`` counts above and ``down`` below in all."""
        rows = np.arange(len(points))
        zero = np.zeros(len(points), np.int16)
        # per node: rows, counts used up and down, and the box's bounds where cut
        todo = [(0, rows, zero, zero, {})]
        while todo:
            node, own, above, below, box = todo.pop()
            d = self.dim[node]
            if d < 0:
                yield self.number[node], own
                continue
            x, bound = points[own, d].astype(np.int16), self.bound[node]
            low, high = box.get(d, (None, None))
            # at most ``bound``: the box's upper end comes down
            cost = np.maximum(0, x - bound) - (np.maximum(0, x - high) if high is not None else 0)
            fits = below + cost <= down
            if fits.any():
                todo.append((self.left[node], own[fits], above[fits], (below + cost)[fits], {**box, d: (low, bound)}))
            cost = np.maximum(0, bound + 1 - x) - (np.maximum(0, low - x) if low is not None else 0)
            fits = above + cost <= up
            if fits.any():
                todo.append((self.left[node] + 1, own[fits], (above + cost)[fits], below[fits], {**box, d: (bound + 1, high)}))


# ---- letter order ----------------------------------------------------------


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b`` (letters of one length) differ in one place."""
    unequal = np.zeros((len(a), len(b)), np.uint8)
    for j in range(a.shape[1]):
        unequal += a[:, j, None] != b[None, :, j]
        if j % 64 == 63:
            np.minimum(unequal, 2, out=unequal)  # no overflow
    return unequal == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a row of ``b`` is one of ``a`` with one letter put in."""
    n = a.shape[1]
    head, tail = np.zeros((len(a), len(b)), np.int32), np.zeros((len(a), len(b)), np.int32)
    same = np.ones((len(a), len(b)), bool)
    for j in range(n):
        same &= a[:, j, None] == b[None, :, j]
        if not same.any():
            break
        head += same
    same[:] = True
    for j in range(n - 1, -1, -1):
        same &= a[:, j, None] == b[None, :, j + 1]
        if not same.any():
            break
        tail += same
    return head + tail >= n


def found_in(members: np.ndarray, visitors: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitors, members) that are near, by row numbers, part by part; members
    and visitors as letters, members one letter ``longer`` or not."""
    if not len(members) or not len(visitors):
        return
    tree = Tree(letter_counts(members), LEAF)
    verify = inserted if longer else replaced
    for at in range(0, len(visitors), BATCH):
        some = visitors[at : at + BATCH]
        for leaf, rows in tree.reached(letter_counts(some), 1, 0 if longer else 1):
            own = tree.rows[leaf]
            step = max(1, (1 << 20) // len(own))
            for first in range(0, len(rows), step):
                v, m = np.nonzero(verify(some[rows[first : first + step]], members[own]))
                if len(v):
                    yield at + rows[first + v], own[m]


# ---- the search ------------------------------------------------------------


class _Router:
    """Cells of words: the top trees of all lengths up to ``TREE_LENGTH``."""

    def __init__(self, trees: dict[int, Tree]):
        self.trees, self.first, at = trees, {}, 0
        for length in sorted(trees):
            self.first[length], at = at, at + len(trees[length].rows)
            trees[length].rows = [None] * len(trees[length].rows)

    def cells(self, codes: np.ndarray, length: int, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell of words of ``length``, rows of ``codes`` that reach it)."""
        if length in self.trees:
            for leaf, rows in self.trees[length].reached(letter_counts(codes), up, down):
                yield self.first[length] + leaf, rows
        else:
            yield -length - 1, np.arange(len(codes))

    def routed(self, words: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, role, numbers of words): role 0 members, 1 visitors of their
        own length, 2 visitors one letter shorter. A word visits its own cell as a member."""
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            codes = np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(len(own), -1)
            home = np.zeros(len(own), np.int64)
            for cell, rows in self.cells(codes, int(length), 0, 0):
                home[rows] = cell
                yield cell, 0, own[rows]
            for cell, rows in self.cells(codes, int(length), 1, 1):
                rows = rows[home[rows] != cell]
                if len(rows):
                    yield cell, 1, own[rows]
            for cell, rows in self.cells(codes, int(length) + 1, 1, 0):
                if len(rows):
                    yield cell, 2, own[rows]


def _top_trees(words: DataFrame) -> _Router:
    """Trees of all lengths from a sample by hash, about SAMPLE words of all."""
    short = words.where(F.length("word") <= TREE_LENGTH)
    total = short.count()
    part = min(1.0, SAMPLE / max(1, total))
    rows = short.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(part * (1 << 30))).select("word").collect()
    by_length: dict[int, list[bytes]] = {}
    for r in sorted(r["word"] for r in rows):
        by_length.setdefault(len(r), []).append(r.encode("latin-1"))
    most = max(LEAST_SAMPLE, int(CELL * part))
    points = {n: letter_counts(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), n)) for n, own in by_length.items()}
    return _Router({n: Tree(p, most) for n, p in points.items()})


def _salt(words: list[bytes], of: int) -> np.ndarray:
    return (mix64(np.array([zlib.crc32(w) for w in words], np.uint64) + np.uint64(1)) % np.uint64(of)).astype(np.int64)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): the number of near words of ``words``
    (word, n; distinct), and the one of largest n (ties: the smallest). Words
    without near ones have no row."""
    router = _top_trees(words)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            own = letters(batch.column(0))
            for cell, role, rows in router.routed(own):
                held[cell, min(role, 1)] += sum(len(own[i]) for i in rows) if role == 0 else len(rows)
        if held:
            cells, roles = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(roles, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["cell", "role", "held"])

    limit = F.when(F.col("role") == 0, BLOCK_BYTES).otherwise(VISITORS)
    large = words.select("word").mapInArrow(sizes, "cell long, role int, held long").groupBy("cell", "role").agg(F.sum("held").alias("held")).where(F.col("held") > limit)
    blocks = {(r["cell"], r["role"]): -(-r["held"] // (BLOCK_BYTES if r["role"] == 0 else VISITORS)) for r in large.collect()}  # a row per BLOCK_BYTES at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = letters(batch.column(0)), batch.column(1).to_numpy()
            for cell, role, rows in router.routed(own):
                m, v = blocks.get((cell, 0), 1), blocks.get((cell, 1), 1)
                if m == v == 1:
                    yield _routed(cell, [(0, 0)], role, own, n, rows)
                    continue
                salt = _salt([own[i] for i in rows], v if role else m)
                for s in np.unique(salt):
                    if role:
                        yield _routed(cell, [(i, int(s)) for i in range(m)], role, own, n, rows[salt == s])
                    else:  # block s of members meets all visitors, and as visitors (role 1) all other blocks of members
                        yield _routed(cell, [(int(s), j) for j in range(v)], 0, own, n, rows[salt == s])
                        other = _salt([own[i] for i in rows[salt == s]], v)
                        for j in np.unique(other):
                            yield _routed(cell, [(i, int(j)) for i in range(m) if i != s], 1, own, n, rows[salt == s][other == j])

    def search(table: pa.Table) -> pa.Table:
        roles, n = table.column("role").to_numpy(), table.column("n").to_numpy()
        words = [w for chunk in table.column("word").chunks for w in chunk.to_pylist()]
        first = table.column("j")[0].as_py() == 0  # members meet each other in one block only
        count = np.zeros(len(words), np.int64)
        best = np.full(len(words), -1, np.int64)
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))

        def met(a: np.ndarray, b: np.ndarray) -> None:
            """b are near words of a: count them, keep the best of each."""
            np.add.at(count, a, 1)
            order = np.lexsort((place[b], -n[b], a))
            a, b = a[order], b[order]
            lead = np.concatenate([[True], a[1:] != a[:-1]])
            a, b = a[lead], b[lead]
            old = best[a]
            wins = (old < 0) | (n[b] > n[old]) | ((n[b] == n[old]) & (place[b] < place[old]))
            best[a[wins]] = b[wins]

        members = np.flatnonzero(roles == 0)
        if len(members):
            length = len(words[members[0]])
            codes = _codes(words, members, length)
            for role, longer in ((1, False), (2, True)):
                visitors = np.flatnonzero((roles == role) | ((roles == 0) & (not longer and first)))
                for v, m in found_in(codes, _codes(words, visitors, length - longer), longer):
                    met(visitors[v], members[m])
                    if longer:
                        met(members[m], visitors[v])
        own = np.flatnonzero(count)
        told = [[words[i].decode("latin-1") for i in own], count[own], n[best[own]], [words[best[i]].decode("latin-1") for i in own]]
        return pa.table([pa.array(c, f.type) for c, f in zip(told, FOUND, strict=True)], schema=FOUND)

    FOUND = pa.schema([("word", pa.string()), ("c", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
    dealt = words.select("word", "n").mapInArrow(route, "cell long, i int, j int, role int, word binary, n long")
    found = dealt.groupBy("cell", "i", "j").applyInArrow(search, "word string, c long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("near_n"), "best.near")


def _codes(words: list[bytes], rows: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), length)


def _routed(cell: int, pairs: list[tuple[int, int]], role: int, words: list[bytes], n: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    own = pa.array([words[i] for i in rows], pa.binary())
    size, times = len(rows), len(pairs)
    columns = [
        pa.array(np.full(size * times, cell, np.int64)),
        *[pa.array(np.repeat(np.array([p[x] for p in pairs], np.int32), size)) for x in (0, 1)],
        pa.array(np.full(size * times, role, np.int32)),
        pa.concat_arrays([own] * times),
        pa.array(np.tile(n[rows], times)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "i", "j", "role", "word", "n"])


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, times: int = 10, one_in: int = 31) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words come from the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts
    (null: none), A-Z lower-cased. Where ``one_in`` divides h, the unsigned
    crc32 of ``<key>:<run>`` (null key: nothing before the colon), the run's
    letter number h modulo its length is deleted (0: no run is altered).
    Counted are results of ``least_length`` letters or more; those with
    ``least_count`` occurrences are the words. Two words are near if one
    inserted, deleted or replaced letter makes one the other. A word's form is
    its near word of largest n (ties: the smallest) if that n is ``times`` its
    own or more, else null; the root follows forms to the last. Equal rows
    count each. No words: an empty table. Other columns are not read.
    """
    if times < 2 or least_length < 1:
        raise ValueError("times must be 2 or more, so that forms end, and least_length 1 or more")
    words = written(counted_words(docs, key, text, least_length, one_in).where(F.col("n") >= least_count), "words")
    near = written(near_words(words), "near-words")
    form = F.col("near_n") >= times * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")
    )
    told = written(told, "forms")
    # each step doubles how far a word looks; n grows tenfold by each form, so few steps reach the last
    roots = written(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if not step.where("moved").head(1):
            break
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
