"""N-gram Jaccard join: near-duplicate components of documents.

Two documents link when their sets of 5-word shingles have a Jaccard similarity
of 0.8 or more.  Count vectors alone can't split a large corpus (in few
dimensions unrelated texts of a size look alike), so buckets come first, without
loss, and the count-vector tree works within them:

1. Sets.  Equal sets collapse to one class (cid, a hash of the set).  Shingles
   are hashed into GROUPS groups; the counts by group are the class's point.
2. Buckets.  Under any one order of all shingles, two sets that link share a
   shingle among each one's first n - ceil(0.8 n) + 1.  The order takes rare
   shingles first: those that are frequent in some partition are counted (all
   documents; at most MAX_FREQUENT are told to the tasks) and go last.  The
   order decides only how large buckets get, never which links are found.
3. Leaders.  In each bucket a class takes as leader the one that the bound (the
   sum of coordinate minima) allows best, or becomes a leader itself: at most
   one pair a row, where a group of copies would give all pairs.  Pairs are
   verified on whole texts; verified links give components.
4. Tree.  Buckets that still hold several components are joined by a packed
   R-tree of their points: node pairs whose bound is below the overlap needed,
   or of one component, are dropped.  First the best surviving pair of each two
   components is verified, which joins most of those that do link; then all
   surviving pairs of components that are still apart.  Large buckets are dealt
   in pairs of chunks, so every pair is seen and no task holds a whole bucket.
   Each class carries the FIRST least tokens of its buckets; a pair that meets in
   a bucket of a lesser token, as these show, is left to that bucket.  The bucket
   of a pair's least token always keeps it.

Within a component no further pair is tested: its links can't change it.  Hashes
have 64 bits.

Null texts, and texts without words, have an empty set and link with nothing.
Fewer than five words make one shingle.  Rows of one doc_id are answered each;
null ids never name a component that has another id.  Only doc_id and text are
read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import discard, frugal, sized, slices, slim_batches, text_bytes, without, written

SHINGLE = 5
NUM, DEN = 4, 5
GROUPS = 32
WIDE = 256
CHUNK = 1500
#: Rows of a bucket that share leaders; what they miss is left to the tree.
LED = 400
LEAF = 16
FIRST = 16
MAX_FREQUENT = 200_000
FREQUENT = 16
COUNT_AT_ONCE = 4_000_000
#: A token reported this often is dealt over several tasks.
HOT = 100_000
PAIRS_AT_ONCE = 100_000
SETS = "doc_id long, mark long, n long, cid long, proof long, vec binary, wide binary, tokens array<long>, counts array<long>"
SET_NAMES = [x.split()[0] for x in SETS.split(", ")]
# Odd multipliers of the rolling combination.
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@functools.cache
def byte_codes() -> np.ndarray:
    """A 64-bit code of each byte: A-Z as a-z, white space as 0."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * WEIGHTS[0])
    codes[65:91] = codes[97:123]
    codes[[9, 10, 11, 12, 13, 32]] = 0
    return codes


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as needed."""

    base = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (self.base, inverse))
        return self.up[:n], self.down


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts that start and end at `at`, from
    all their bytes at once (sums of byte codes times powers of their place,
    shifted to the word's start), and the index of each text's first word."""
    codes = byte_codes()[raw]
    n = len(raw)
    inner = codes != 0
    fresh = np.ones(n + 1, bool)  # where words may start or stop
    fresh[1:n] = inner[1:] != inner[:-1]
    fresh[at] = True
    edge = np.flatnonzero(fresh)
    start = edge[:-1][inner[edge[:-1]]] if n else np.zeros(0, np.int64)
    stop = edge[1:][inner[edge[:-1]]] if n else start
    up, down = POWERS.upto(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:n], dtype=np.uint64)])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)), np.searchsorted(start, at)


def text_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word runs, one text after the
    other, and where each text's begin; only A-Z are lower-cased."""
    words, first = word_hashes(raw, at)
    number = np.diff(first)
    whole = number >= SHINGLE
    size = np.where(whole, number - SHINGLE + 1, np.minimum(number, 1))
    total = max(0, len(words) - SHINGLE + 1)
    h = np.full(total, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        h += words[j : j + total] * WEIGHTS[j]
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(begin[-1], np.uint64)
    ends = begin[1:]
    i = np.arange(begin[-1]) + np.repeat(first[:-1] - (ends - size), size)
    own = np.repeat(whole, size)
    out[own] = h[i[own]]
    for d in np.flatnonzero(~whole & (number > 0)).tolist():
        k, x = int(number[d]), np.uint64(number[d])
        for j in range(k):
            x = x + words[first[d] + j] * WEIGHTS[j]
        out[begin[d]] = x
    out = mix(out)
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi - lo > 1:
            out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]


def array_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, shingles, places) of runs of the texts."""
    raw, at = text_bytes(texts)
    for lo, hi in slices(at):
        with np.errstate(over="ignore"):
            yield lo, hi, *text_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])


def each_set(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, s, at in array_sets(texts):
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield s[lo:hi]


def shingles(text: str | None) -> np.ndarray:
    """The set of one text."""
    return next(each_set(pa.array([text], pa.string())))


def needed(a, b):
    """Least overlap of sets of these sizes that link: 100 * I >= 80 * U, with
    U = a + b - I, in whole numbers."""
    return -((-NUM * (a + b)) // (NUM + DEN))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    overlap = int((b[at] == a).sum())
    return DEN * overlap >= NUM * (len(a) + len(b) - overlap)


def points(s: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    """Counts by group of each set, a row a set."""
    n = len(at) - 1
    cell = np.repeat(np.arange(n) * groups, np.diff(at)) + (s % np.uint64(groups)).astype(np.int64)
    return np.bincount(cell, minlength=n * groups).reshape(n, groups)


def wide_points(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """WIDE counts cut at 255, and what was cut off in all: the overlap of two
    sets is at most the sum of the minima plus the lesser of the two excesses."""
    full = points(s, at, WIDE)
    cut = np.minimum(full, 255)
    more = (full - cut).sum(1)
    return [c + int(m).to_bytes(4, "little") for c, m in zip(map(bytes, cut.astype(np.uint8)), more, strict=True)]


def class_ids(s: np.ndarray, at: np.ndarray, seed: int) -> tuple[list[int], list[int]]:
    """Two 64-bit hashes of each set: the class's name, and its check."""
    import xxhash

    both = [xxhash.xxh3_128_intdigest(s[lo:hi].tobytes(), seed) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [(x >> 64) - 2**63 for x in both], [(x & (2**64 - 1)) - 2**63 for x in both]


def set_table(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, mark, n, cid, proof, vec, wide) of each row; mark is a hash of the
    text.  Besides, rows of (tokens, counts): shingles that a run of the
    distinct sets a task reads holds twice or more, counted over runs of bounded
    size, so that no shingle crosses the network to be counted alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def report() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            tokens.sort()
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            n = np.diff(np.append(first, len(tokens)))
            keep = n > 1
            none = [pa.nulls(1, t) for t in (*[pa.int64()] * 5, pa.binary(), pa.binary())]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (tokens[first[keep]].view(np.int64), n[keep].astype(np.int64))]
            return pa.RecordBatch.from_arrays([*none, *lists], SET_NAMES)

        for b in batches:
            for lo, hi, s, at in array_sets(b.column(2)):
                ids, proof = class_ids(s, at, seed)
                vec = [x.tobytes() for x in points(s, at, GROUPS).astype("<i4")]
                none = pa.nulls(hi - lo, pa.list_(pa.int64()))
                doc, mark = (b.column(k).slice(lo, hi - lo) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [doc, mark, pa.array(np.diff(at), pa.int64()), pa.array(ids, pa.int64()), pa.array(proof, pa.int64()), pa.array(vec, pa.binary()), pa.array(wide_points(s, at), pa.binary()), none, none], SET_NAMES
                )
                for c, x, y in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if c not in seen:
                        seen.add(c)
                        held.append(s[x:y])
                        size += y - x
                        if size >= COUNT_AT_ONCE:
                            yield report()
                            held, size, seen = [], 0, set()
        if held:
            yield report()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return slim.mapInArrow(frugal(run), SETS)


def class_table(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(set_table, classes, seed of the names), written.  Should two different sets share a name, as
    their second hashes tell, all names are drawn anew."""
    seed = 0
    while True:
        table = written(set_table(docs, seed), "sets")
        of = table.where("n > 0").groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "vec", "wide")], (F.min("proof") != F.max("proof")).alias("clash"))
        classes = written(of, "classes")
        if not classes.where("clash").head(1):
            return table, classes, seed
        discard(table, classes)
        seed += 1


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent reported shingles, in their order (rarest first), and
    how often they were reported."""
    rows = sets.where("tokens IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    found = rows.groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.counts").alias("n"))
    top = found.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    return tuple(top.column(c).to_numpy()[::-1].copy() for c in ("token", "n"))


def prefix(s: np.ndarray, tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of s in the common order: hash order, frequent last.
    tokens: frequent ones, sorted; rank: their places in the order."""
    size = int(prefix_size(len(s)))
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        hit = tokens[at] == s
        s = np.concatenate([s[~hit], s[hit][np.argsort(rank[at[hit]])]])
    return s[:size]


def prefix_size(n):
    return n - (NUM * n + DEN - 1) // DEN + 1


class Prefixes:
    """prefix() of many sets at once: those with enough shingles that aren't
    frequent need no look at the order."""

    BITS = 22

    def __init__(self, tokens: np.ndarray, rank: np.ndarray) -> None:
        self.tokens, self.rank = tokens, rank
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self.cell(tokens)] = True

    def cell(self, s: np.ndarray) -> np.ndarray:
        return (s >> np.uint64(64 - self.BITS)).astype(np.int64)

    def frequent(self, s: np.ndarray) -> np.ndarray:
        hit = self.maybe[self.cell(s)]
        some = s[hit]
        if len(some):
            hit[hit] = self.tokens[np.minimum(np.searchsorted(self.tokens, some), len(self.tokens) - 1)] == some
        return hit

    def of(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, index of their set)."""
        n = np.diff(at)
        size = np.where(n > 0, prefix_size(n), 0)
        rare = ~self.frequent(s)
        before = np.concatenate([[0], np.cumsum(rare)])
        enough = before[at[1:]] - before[at[:-1]] >= size
        of = np.repeat(np.arange(len(n)), n)
        keep = rare & enough[of] & (before[:-1] - before[at[:-1]][of] < size[of])
        out, ids = [s[keep]], [of[keep]]
        for d in np.flatnonzero(~enough).tolist():
            out.append(prefix(s[at[d] : at[d + 1]], self.tokens, self.rank))
            ids.append(np.full(len(out[-1]), d))
        return np.concatenate(out), np.concatenate(ids)


def incidence(docs: DataFrame, order: np.ndarray, seed: int) -> DataFrame:
    """(token, cid): each class under each shingle of its prefix.  A task gives
    equal sets once."""
    sort = np.argsort(order)
    told = docs.sparkSession.sparkContext.broadcast((order[sort], sort))  # MAX_FREQUENT at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes(*told.value)
        seen: set[int] = set()
        for b in batches:
            if len(seen) > COUNT_AT_ONCE // 8:
                seen = set()
            for _, _, s, at in array_sets(b.column(0)):
                ids = class_ids(s, at, seed)[0]
                new = []
                for c, n in zip(ids, np.diff(at).tolist(), strict=True):
                    new.append(n > 0 and c not in seen)
                    seen.add(c)
                keep = np.array(new, bool)
                size = np.diff(at)
                mine = s[np.repeat(keep, size)]
                tokens, which = prefixes.of(mine, np.concatenate([[0], np.cumsum(size[keep])]))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.array(ids, np.int64)[keep][which])], ["token", "cid"])

    return docs.select("text").mapInArrow(frugal(run), "token long, cid long")


def buckets(docs: DataFrame, classes: DataFrame, order: np.ndarray, counts: np.ndarray, seed: int) -> DataFrame:
    """(token, cid, n, vec, size): buckets of two classes or more; of buckets
    with the same classes, one.

    Tokens reported HOT times or more are dealt over several tasks, and their
    parts' sizes summed; there are few of them, as the reports sum to the rows."""
    rows = incidence(docs, order.view(np.uint64), seed)
    hot = [(int(t), -(-int(n) // HOT)) for t, n in zip(order[counts >= HOT], counts[counts >= HOT], strict=True)]
    if hot:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(hot, "token long, parts long")), "token", "left")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))))
    else:
        rows = rows.withColumns({"parts": F.lit(None).cast("long"), "part": F.lit(0).cast("long")})
    key = ["token", "part"]
    # equal classes from several tasks are next to each other in the sort
    same, first = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("cid")
    rows = rows.withColumn("prev", F.lag("cid").over(first)).where("prev IS NULL OR prev <> cid").drop("prev")
    who = F.bit_xor(F.xxhash64("cid"))
    rows = rows.withColumn("size", F.count("*").over(same)).withColumn("who", who.over(same)).where("size > 1 OR parts IS NOT NULL")
    rows = table = written(rows.drop("part"), "incidence")
    if hot:
        whole = rows.where("parts IS NOT NULL").groupBy("token").agg(F.count("*").alias("size"), who.alias("who"))
        rows = rows.where("parts IS NULL").unionByName(rows.where("parts IS NOT NULL").drop("size", "who").join(F.broadcast(whole), "token"))
        rows = rows.where("size > 1")
    one = rows.groupBy("who", "size").agg(F.min("token").alias("token")).select("token")
    kept = rows.join(one, "token", "left_semi").drop("who", "parts")
    out = written(kept.join(classes.select("cid", "n", "vec"), "cid"), "buckets")
    discard(table)
    return out


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of equal first `keys` columns of sorted batches, as arrays."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        key = np.stack([t.column(k).to_numpy() for k in range(keys)])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if not len(cut):
            rest = t
            continue
        rest = t.slice(int(cut[-1]))
        yield from _arrays(t.slice(0, int(cut[-1])), [0, *cut.tolist()], keys)
    if rest is not None and rest.num_rows:
        yield from _arrays(rest.combine_chunks(), [0, rest.num_rows], keys)


def _arrays(t: pa.Table, cut: list[int], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    t = t.combine_chunks()
    raw = t.column(t.num_columns - 1).to_pylist()
    vec = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    cols = [_column(t.column(k)) for k in range(keys, t.num_columns - 1)]
    for lo, hi in zip(cut, cut[1:], strict=False):
        if hi - lo > 1:
            yield (*(c[lo:hi] for c in cols), vec[lo:hi])


def _column(c: pa.ChunkedArray) -> np.ndarray:
    """A column as an array; lists, all of one length, as rows."""
    if not pa.types.is_list(c.type):
        return c.to_numpy()
    return c.combine_chunks().flatten().to_numpy().reshape(len(c), -1)


def leader_pairs(cid: np.ndarray, n: np.ndarray, vec: np.ndarray) -> list[tuple[int, int]]:
    """(class, leader) in one bucket, at most one pair a class."""
    vec = np.ascontiguousarray(vec).view("<i4")
    order = np.lexsort((cid, n))
    lead, out = [int(order[0])], []
    for i in order[1:].tolist():
        at = np.array(lead)
        bound = np.minimum(vec[at], vec[i]).sum(1) - needed(n[at], n[i])
        best = int(bound.argmax())
        if bound[best] >= 0:
            out.append((int(cid[i]), int(cid[at[best]])))
        else:
            lead.append(i)
    return out


def tree_levels(n: np.ndarray, lab: np.ndarray, vec: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """A packed R-tree: points sorted by component, size and first coordinates;
    levels of (least size, least and greatest component, greatest excess,
    greatest counts), leaves first."""
    counts, extra = vec[:, :WIDE], np.ascontiguousarray(vec[:, WIDE:]).view("<u4").ravel().astype(np.int64)
    order = np.lexsort((counts[:, 1], counts[:, 0], n, lab))
    levels = [(n[order], lab[order], lab[order], extra[order], counts[order])]
    while len(levels[-1][0]) > 1:
        low, first, last, more, high = levels[-1]
        at = np.arange(0, len(low), LEAF)
        levels.append((np.minimum.reduceat(low, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at), np.maximum.reduceat(more, at), np.maximum.reduceat(high, at, axis=0)))
    return order, levels


def tree_pairs(n: np.ndarray, lab: np.ndarray, vec: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of different components whose bound allows a link, and by how
    much the bound is above the overlap needed: node pairs are followed from the root while the sum of coordinate minima reaches the
    overlap needed and they aren't of one component."""
    order, levels = tree_levels(n, lab, vec)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack += [(level, a[k : k + PAIRS_AT_ONCE], b[k : k + PAIRS_AT_ONCE]) for k in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        low, first, last, more, high = levels[level]
        # sizes alone first: an overlap is at most the smaller set, which for nodes of least sizes says nothing but at the points
        keep = (first[a] != last[b]) | (last[a] != first[b])
        if level == 0:
            keep &= (a < b) & (np.minimum(low[a], low[b]) >= needed(low[a], low[b]))
        a, b = a[keep], b[keep]
        bound = np.minimum(high[a], high[b]).sum(1, dtype=np.int64) + np.minimum(more[a], more[b])
        keep = bound >= needed(low[a], low[b])
        a, b = a[keep], b[keep]
        if level == 0:
            if len(a):
                yield order[a], order[b], bound[keep] - needed(low[a], low[b])
            continue
        size = len(levels[level - 1][0])
        step = np.arange(LEAF)
        for k in range(0, len(a), PAIRS_AT_ONCE // LEAF**2):
            part = slice(k, k + PAIRS_AT_ONCE // LEAF**2)
            x, y = np.broadcast_arrays(a[part, None, None] * LEAF + step[None, :, None], b[part, None, None] * LEAF + step[None, None, :])
            fine = (x < size) & (y < size) & (x <= y)
            if fine.any():
                stack.append((level - 1, x[fine], y[fine]))


def _pairs(rows: DataFrame, keys: list[str], cols: list[str], point: str, find) -> DataFrame:
    """find() on each group of rows, which are dealt and sorted by keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        known: set[tuple[int, int]] = set()  # a pair meets in several buckets
        for group in _groups(batches, len(keys)):
            for pair in find(*group):
                if pair in known:
                    continue
                if len(known) >= 10 * PAIRS_AT_ONCE:
                    known = set()
                known.add(pair)
                found.append(pair)
                if len(found) >= PAIRS_AT_ONCE:
                    yield pack()
                    found = []
        yield pack()

    dealt = rows.select(*keys, *cols, point).repartition(*keys).sortWithinPartitions(*keys, "cid")
    return dealt.mapInArrow(frugal(run), "a long, b long").distinct()


def by_leaders(rows: DataFrame) -> DataFrame:
    """Candidate pairs of a leader round; large buckets are dealt over chunks."""
    salt = F.pmod(F.xxhash64("cid", "token"), F.ceil(F.col("size") / LED)).cast("long").alias("chunk")
    return _pairs(rows.select("token", salt, "cid", "n", "vec"), ["token", "chunk"], ["cid", "n"], "vec", leader_pairs)


def best_of(lab: np.ndarray, i: np.ndarray, j: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each two components' pairs, the one of largest margin."""
    one, two = np.minimum(lab[i], lab[j]), np.maximum(lab[i], lab[j])
    order = np.lexsort((-margin, two, one))
    first = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    at = order[first]
    return i[at], j[at], margin[at]


def first_tokens(rows: DataFrame) -> DataFrame:
    """(cid, least): the FIRST least tokens of a class's buckets, the last one
    repeated where there are fewer."""
    some = F.slice(F.array_sort(F.collect_list("token")), 1, FIRST)  # a prefix, no longer than the text
    some = rows.groupBy("cid").agg(some.alias("some"))
    return some.select("cid", F.slice(F.concat("some", F.array_repeat(F.element_at("some", -1), FIRST)), 1, FIRST).alias("least"))


def met_before(token: int, least: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the classes i and j share a known token below this one."""
    a, b = least[i], least[j]
    out = np.zeros(len(i), bool)
    for k in range(least.shape[1]):
        out |= ((a == b[:, k : k + 1]).any(1)) & (b[:, k] < token)
    return out


def by_tree(rows: DataFrame, best: bool) -> DataFrame:
    """Candidate pairs between components (lab): all of them, or the best pair
    of each two components in a bucket.  A bucket of k chunks becomes
    its pairs of chunks, so all its pairs meet in one group."""
    k = F.ceil(F.col("size") / CHUNK)
    cut = rows.join(first_tokens(rows), "cid").withColumn("chunk", F.pmod(F.xxhash64("cid"), k)).withColumn("k", k)
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    cell = F.least("chunk", "o") * F.col("k") + F.greatest("chunk", "o")
    # 0: a chunk with itself; -1 and 1: the two chunks of other groups, where only pairs across count
    dealt = cut.withColumn("cell", cell).withColumn("side", F.signum(F.col("chunk") - F.col("o")).cast("long")).withColumn("home", F.col("token"))

    def find(cid: np.ndarray, n: np.ndarray, lab: np.ndarray, side: np.ndarray, home: np.ndarray, least: np.ndarray, vec: np.ndarray) -> Iterator[tuple[int, int]]:
        def here() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for found in tree_pairs(n, lab, vec):
                i, j, _ = found
                keep = (side[i] == 0) | (side[i] != side[j])
                keep[keep] = ~met_before(home[0], least, i[keep], j[keep])
                if keep.any():
                    yield tuple(x[keep] for x in found)

        found = here()
        if best:
            top: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
            for more in found:
                top = best_of(lab, *(more if top is None else map(np.concatenate, zip(top, more, strict=True))))
            found = iter([top] if top else [])
        for i, j, _ in found:
            yield from zip(np.minimum(cid[i], cid[j]).tolist(), np.maximum(cid[i], cid[j]).tolist(), strict=True)

    return _pairs(dealt, ["token", "cell"], ["cid", "n", "lab", "side", "home", "least"], "wide", find)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link, tested on whole texts.  texts: (cid, text), a row a
    class.  Each class's text moves once a pair at most; the pairs are broadcast
    while they are few, and shuffled otherwise."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slim_batches(batches, 2):
            heads = b.column(3).dictionary_encode()  # a leader's text comes with each of its followers
            known = list(each_set(heads.dictionary))
            keep = [linked(x, known[k]) for x, k in zip(each_set(b.column(2)), heads.indices.to_pylist(), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    pairs = written(pairs, "pairs")
    left = texts.withColumnRenamed("cid", "a").withColumnRenamed("text", "ta").join(sized(pairs), "a")
    heads = written(pairs.select("b").distinct(), "heads")
    right = texts.withColumnRenamed("cid", "b").withColumnRenamed("text", "tb").join(sized(heads), "b", "left_semi")
    both = left.join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
    out = written(both.mapInArrow(frugal(run), "a long, b long"), "links")
    discard(pairs, heads)
    return out


def components(links: DataFrame) -> DataFrame:
    """(cid, lab), written: the least class of each component.  Labels spread to
    neighbours and jump to their label's label, until nothing changes."""
    ends = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "ends")
    lab = written(ends.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("m")).select("cid", F.least("cid", "m").alias("lab")), "labels")
    while True:
        few = sized(lab)
        near = ends.join(few.select(F.col("cid").alias("b"), F.col("lab").alias("m")), "b").groupBy(F.col("a").alias("cid")).agg(F.min("m").alias("m"))
        spread = written(lab.join(near, "cid").select("cid", F.least("lab", "m").alias("new"), F.col("lab").alias("old")), "spread")
        jump = sized(spread).select(F.col("cid").alias("new"), F.col("new").alias("far"))
        least = F.least("new", "far")
        done = written(spread.join(jump, "new").select("cid", least.alias("lab"), (least != F.col("old")).alias("moved")), "labels")
        discard(lab, spread)
        lab = done
        if not done.where("moved").head(1):
            discard(ends)
            return lab


def open_buckets(rows: DataFrame, lab: DataFrame) -> DataFrame:
    """The rows of buckets with several components, with lab."""
    marked = rows.join(sized(lab).select("cid", "lab"), "cid", "left").withColumn("lab", F.coalesce("lab", "cid"))
    several = marked.groupBy("token").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo <> hi").select("token")
    return marked.join(several, "token", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, for each row."""
    docs = docs.select("doc_id", "text")
    table, classes, seed = class_table(docs)
    sets = table.where("cid IS NOT NULL").drop("tokens", "counts")
    rows = buckets(docs, classes, *frequent(table), seed)
    texts = class_texts(docs, sets, rows)

    links = [verified(by_leaders(rows), texts)]
    lab = components(links[0])
    for best in (True, False):
        rest = written(open_buckets(rows, lab).join(classes.select("cid", "wide"), "cid").select("token", "cid", "n", "size", "lab", "wide"), "open")
        if rest.head(1):
            links.append(verified(by_tree(rest, best), texts))
            discard(lab)
            lab = components(reduce(DataFrame.union, links))
        discard(rest)
    discard(texts, rows, classes, *links)

    named = sets.select("doc_id", "n", "cid").join(sized(lab).select("cid", "lab"), "cid", "left").withColumn("comp", F.coalesce("lab", "cid"))
    # only what is linked, or held by several rows, needs a look at the others
    least = written(named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("comp", "least"), "least")
    out = named.join(sized(least), "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def class_texts(docs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(cid, text) of the classes in buckets, one text a class, written."""
    one = F.min(F.struct("doc_id", "mark")).alias("d")
    wanted = sets.join(rows.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(one).select("cid", F.col("d.doc_id").alias("_id"), F.col("d.mark").alias("_mark"))
    wanted = written(wanted, "wanted")
    marked = docs.withColumn("mark", F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(F.col("_id")) & (marked["mark"] == F.col("_mark"))
    found = marked.join(sized(wanted), same)
    # rows of one doc_id and text are one class
    out = written(found.select("cid", "text").dropDuplicates(["cid"]), "texts")
    discard(wanted)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of smallest id of each component; of rows that share that
    id, all.  Documents without words stay, and so does every row of an id of
    which one row stays."""
    named = near_duplicates(docs)
    return without(docs, named.groupBy("doc_id").agg(F.bool_or(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("stays")).where("NOT stays"))
