"""Packing documents into sequences by cutting-stock column generation.

A document's tokens are its ids and one end id.  It is cut into full sequences,
a half and a quarter of one where they fit, then a piece of whole units (UNIT
tokens each), then a tail of less than a unit, so piece lengths fall into a fixed number of classes whatever the corpus.  The
histogram of the classes is a cutting-stock problem: a linear program over
patterns (how many pieces of each class share a sequence), solved by column
generation with the revised simplex method; a knapsack over the capacity prices
the next column.  Whole multiples of each pattern are taken, what is left over
is packed greedily by class counts, and the pieces of each class, ranked, are
dealt to the patterns' places by arithmetic.

Only the histogram (at most 73 rows) reaches the driver; the pattern table
(at most a few hundred patterns) is broadcast.  Null text is empty and packs its
end id alone.  Rows with equal doc_id are packed each on their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.bpe import word_ids
from boxloom.llm.common import frugal, ranked, written

CAPACITY = 2048
UNIT = 64
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int, unit: int) -> list[int]:
    """Lengths of a document's pieces, in order: full sequences, then halves and
    quarters of one, then whole units, then the tail.  Without the halves,
    remainders of just over half a sequence could not share one."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    for part in (capacity // 2, capacity // 4):
        if rest >= part:
            out.append(part)
            rest -= part
    return out + [x for x in (rest - rest % unit, rest % unit) if x]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """A row a piece: PIECE."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode = word_ids(vocabulary).encode
        for b in batches:
            for lo, hi, ids, at in encode(b.column(1), end_id):
                size = np.diff(at)
                parts = [cuts(n, capacity, unit) for n in size.tolist()]
                pieces = np.array([len(p) for p in parts])
                length = np.array([x for p in parts for x in p], np.int64)
                stop = np.cumsum(length)  # a run's pieces follow each other as its ids do
                view = memoryview(ids).cast("B")
                sums = [crc32(view[4 * x : 4 * y]) for x, y in zip((stop - length).tolist(), stop.tolist(), strict=True)]
                start = stop - length - np.repeat(at[:-1], pieces)
                doc = b.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), pieces)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.repeat(size, pieces))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run, keep_caches=True), PIECE)


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best pattern for the given values."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], take[c] = best[c - 1], -1
        fits = sizes <= c
        if fits.any():
            gain = np.where(fits, best[np.where(fits, c - sizes, 0)] + values, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], take[c] = gain[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear program's solution.

    It starts from one pattern a class and stops at the optimum, or at the bound
    total / capacity.  Steps are chosen on a slightly raised demand, other for
    each class, so that none is degenerate; a basis that rounding errors bring
    back ends it.  Each stage is feasible.
    """
    n = len(sizes)
    cols = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(cols))
    raised = demand * (1 + 1e-9 * np.arange(1, n + 1))
    x = inverse @ raised
    bound = float(sizes @ raised) / capacity
    seen: set[bytes] = set()
    while (basis := cols.tobytes()) not in seen:
        seen.add(basis)
        if x.sum() <= bound * (1 + 1e-9) + 1e-9:
            break
        worth, pattern = price(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        cols[:, out] = pattern
        theta = ratio[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    x = np.maximum(inverse @ demand, 0)
    return [(cols[:, i].astype(np.int64), float(x[i])) for i in range(n)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """({length: count}, times): patterns that hold each piece exactly once."""
    sizes = np.array(sorted((s for s, n in histogram.items() if n), reverse=True), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        left = left - pattern * times
        out.append(({int(s): int(a) for s, a in zip(sizes, pattern, strict=True) if a}, int(times)))

    if len(sizes):
        for pattern, times in column_generation(sizes, left.astype(float), capacity):
            if pattern.any() and (fit := min(int(times + 1e-6), int((left[pattern > 0] // pattern[pattern > 0]).min()))) > 0:
                use(pattern, fit)
    while left.any():  # what rounding left: longest first, each pattern as often as it fits
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i, s in enumerate(sizes):
            pattern[i] = min(left[i], room // s)
            room -= int(pattern[i] * s)
        use(pattern, int((left[pattern > 0] // pattern[pattern > 0]).min()))
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, per, first, at): pieces lo..hi-1 of a length go `per` to
    a sequence, from sequence `first` on, from offset `at` on."""
    used: dict[int, int] = {}
    out, first = [], 0
    for pattern, times in patterns:
        at = 0
        for length, per in pattern.items():
            lo = used.get(length, 0)
            used[length] = lo + per * times
            out.append((length, lo, used[length], per, first, at))
            at += length * per
        first += times
    return out


def place(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces + sequence_id, offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity / unit + unit rows
    patterns = plan(counts, capacity)
    rows = places(patterns)
    table = spark.createDataFrame(rows, "length long, lo long, hi long, per long, first long, at long")
    numbered = ranked(pieces, ["length"], F.struct("doc_id", "start"), ["doc_id", "start", "ids_crc32"], sum(counts.values()), "r")
    on = (numbered["length"] == table["length"]) & (numbered["r"] >= table["lo"]) & (numbered["r"] < table["hi"])
    out = numbered.join(F.broadcast(table), on).drop(table["length"])  # a few hundred patterns by their classes
    k = F.col("r") - F.col("lo")
    seq = (F.col("first") + F.floor(k / F.col("per"))).cast("long")
    return out.withColumn("sequence_id", seq).withColumn("offset", (F.col("at") + (k % F.col("per")) * F.col("length")).cast("long")).drop("r", "lo", "hi", "per", "first", "at")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(token_pieces(docs, vocabulary, capacity, unit, end_id), "pieces")
    return place(docs.sparkSession, pieces, capacity)
