"""Line dedup over levelled sorted runs of line hashes.

State: runs of (h1, h2, n_docs, max_doc), all bucketed and sorted by hash in the
same way, in levels.  A batch's lines, counted, meet the sorted runs in merge
joins: a line that no run holds (what an anti-join would give) starts with its
own count, any other goes on from the counts that the runs have for it; the
result is the batch's own run.  So a line's newest row holds its counts over all batches so
far, and a line is known as frequent as soon as a batch brings its min_docs-th
document.  A batch adds one run to level 0; FANOUT runs of a level are compacted
into one of the next, so the number of runs grows with the logarithm of the
batches.  Counts only grow, so compacting keeps the largest.  Buckets are the
same in all runs: neither meeting them nor compacting them shuffles a run.

The corpus rule: a line that at least min_docs documents hold goes, except in the
largest doc_id.  Once the last batch is in, the frequent lines meet the lines of
the documents by hash; only documents that lose lines are rewritten.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased; a key's hash has 128 bits.  Null text counts as one empty line.  A
null doc_id counts as the smallest id; rows of the same doc_id are one document
when counting, and each is rewritten.  An empty table gives an empty one.  Only
text and doc_id are read, other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.llm.common import delete, discard, frugal, plain_names, shared_dir, sized, slim_batches, written

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 2
#: Lines that hold this share of all pairs (one in HEAVY) are joined by broadcast;
#: there are HEAVY of them at most.
HEAVY = 1000
#: Hashes (16 bytes each) of lines to drop that are broadcast at most, in all.
BROADCAST_HASHES = 4_000_000
SPACES = b" \t\n\v\f\r"
KEY = ["h1", "h2"]
PAIR = "doc_id long, h1 long, h2 long"


def long_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """Each line's key, or None where it is shorter than min_chars."""
    # bytes.lower() changes A-Z only
    keys = [line.strip(SPACES) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "surrogatepass")) >= min_chars) else None for k in keys]


def digest(key: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(key)
    return (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63


def line_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2), once per document row and key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slim_batches(batches, 1):
            ids, one, two = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {digest(k) for k in set(long_keys(text, min_chars)) if k is not None}
                ids += [doc] * len(found)
                for x, y in found:
                    one.append(x)
                    two.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), PAIR)


class LineRuns:
    """The levelled runs: bucketed tables in a folder of the shared directory."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        """run is dealt by hash already: a bucket is written by one task."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        out = run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        out.option("path", f"{shared_dir(self.spark)}/{self.name}/{self.made}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{shared_dir(self.spark)}/{self.name}/{name.rpartition('_')[2]}")

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def _newest(self, one: str, two: str) -> DataFrame:
        """One row a line of two runs, its largest counts, by one merge join.
        (A union of bucketed scans under an aggregate needs no shuffle either, but
        Spark 4.1 then takes it for partitioned when it is not.)"""
        more = self.spark.table(two).select(*KEY, F.col("n_docs").alias("n"), F.col("max_doc").alias("m"))
        both = self.spark.table(one).hint("merge").join(more, KEY, "full")
        return both.select(*KEY, F.greatest("n_docs", "n").alias("n_docs"), F.greatest("max_doc", "m").alias("max_doc"))

    def _compacted(self, names: list[str]) -> str:
        """One run of several, two at a time; they are deleted."""
        while len(names) > 1:
            one, two, *rest = names
            names = [*rest, self._write(self._newest(one, two))]
            self._drop(one)
            self._drop(two)
        return names[0]

    def met(self, lines: DataFrame) -> DataFrame:
        """The lines (h1, h2, n_docs, max_doc), merge-joined with each run: a line
        that none holds stays as it is, others take the runs' counts in."""
        n, m = [F.lit(0).cast("long")], [F.col("max_doc")]
        for i, name in enumerate(self.names()):
            run = self.spark.table(name).select(*KEY, F.col("n_docs").alias(f"n{i}"), F.col("max_doc").alias(f"m{i}"))
            lines = lines.join(run.hint("merge"), KEY, "left")
            n.append(F.col(f"n{i}"))
            m.append(F.col(f"m{i}"))
        most = lambda c: F.greatest(*c) if len(c) > 1 else c[0]  # noqa: E731  nulls, of runs without the line, don't count
        return lines.select(*KEY, (F.col("n_docs") + most(n)).alias("n_docs"), most(m).alias("max_doc"))

    def add(self, pairs: DataFrame) -> None:
        """Adds a batch of (doc_id, h1, h2) as a run.  A document's pairs belong
        to one batch.  distinct() first, so a hot line is summed where it is."""
        own = pairs.distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        path = self._write(self.met(own))
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(path)
            if len(self.levels[level]) < self.fanout:
                return
            path = self._compacted(self.levels[level])
            self.levels[level] = []
            level += 1

    def all(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) of all lines, as one run."""
        self.levels = [[self._compacted(self.names())]]
        return self.spark.table(self.levels[0][0])

    def drop(self) -> None:
        for name in self.names():
            self._drop(name)
        delete(self.spark, f"{shared_dir(self.spark)}/{self.name}")


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 3) -> DataFrame:
    """(doc_id, drops): for each document that loses lines, their hashes; written.

    The heaviest lines meet the pairs by broadcast, so that no task gets all
    pairs of one line; the other lines are shuffled."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    pairs = written(line_pairs(docs, min_chars).select("*", batch), "line-pairs")
    runs = LineRuns(docs.sparkSession)
    for b in range(batches):
        runs.add(pairs.where(F.col("batch") == b).drop("batch"))
    hot = written(runs.all().where(F.col("n_docs") >= min_docs), "hot-lines")
    runs.drop()
    heavy = F.col("n_docs") * HEAVY >= pairs.count()  # the n_docs sum to this count at most
    few, narrow = F.broadcast(hot.where(heavy)), pairs.drop("batch")
    rest = narrow.join(few.select(*KEY), KEY, "left_anti").join(hot.where(~heavy), KEY)
    gone = narrow.join(few, KEY).unionByName(rest).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    drops = written(gone.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("drops")), "line-drops")  # no longer than the text
    discard(pairs, hot)
    return drops


def _split(docs: DataFrame, doc_id: str, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that lose lines, with one and two: the hashes; all others)."""
    hashes = drops.agg(F.sum(F.size("drops"))).first()[0] or 0
    gone = (sized(drops) if hashes <= BROADCAST_HASHES else drops).select(F.col("doc_id").alias("gone_id"), F.transform("drops", lambda d: d["h1"]).alias("one"), F.transform("drops", lambda d: d["h2"]).alias("two"))
    same = docs[doc_id].cast("long").eqNullSafe(gone["gone_id"])
    return docs.join(gone, same).drop("gone_id"), docs.join(gone, same, "left_anti")


def keep_lines(text: str | None, gone: set[tuple[int, int]], min_chars: int) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = (text or "").split("\n")
    return [x for x, k in zip(lines, long_keys(text, min_chars), strict=True) if k is None or digest(k) not in gone], len(lines)


def _each(batch: pa.RecordBatch, text: int, min_chars: int) -> Iterator[tuple[list[str], int]]:
    n = batch.num_columns
    for t, x, y in zip(*(batch.column(c).to_pylist() for c in (text, n - 2, n - 1)), strict=True):
        yield keep_lines(t, set(zip(x, y, strict=True)), min_chars)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 3) -> DataFrame:
    """docs with text rewritten and n_chars, if there is one, counted anew.
    Null text stays null."""
    names, at = docs.columns, docs.columns.index("text")
    plain = plain_names(docs)
    schema = plain.schema

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slim_batches(parts, at):
            old, kind = b.column(at), b.schema.field(at).type
            new = ["\n".join(kept) for kept, _ in _each(b, at, min_chars)]
            cols = [pa.array(new, kind, mask=old.is_null().to_numpy(zero_copy_only=False)) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    hit, rest = _split(plain, f"c{names.index('doc_id')}", dropped_keys(docs.select("doc_id", "text"), min_chars, min_docs, batches))
    out = hit.mapInArrow(frugal(run), T.StructType([T.StructField(f.name, f.dataType) for f in schema])).unionByName(rest)
    if "n_chars" in names:
        k = f"c{names.index('n_chars')}"
        out = out.withColumn(k, F.char_length(F.col(f"c{at}")).cast(schema[k].dataType))
    return out.toDF(*names)


def line_digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in slim_batches(parts, 1):
            total, lost, sha = [], [], []
            for kept, n in _each(b, 1, min_chars):
                total.append(n)
                lost.append(n - len(kept))
                sha.append(sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit, rest = _split(slim, "doc_id", dropped_keys(slim, min_chars, min_docs, batches))
    text = F.coalesce("text", F.lit(""))
    lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = rest.select("doc_id", lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))
    return hit.mapInArrow(frugal(run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string").unionByName(whole)
