"""What the operators share: the written table that cuts lineage, exact ranks,
Python tasks that give their memory back."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of keys that are broadcast at most; larger sets are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Rows that a sub-group of ranked() holds on average, where there are many.
RANK_ROWS = 200_000
#: Bytes of text that are handled at once (a longer text alone).
BYTES_AT_ONCE = 2_000_000
#: What empties the caches that a worker keeps between tasks.
CACHES: list[Callable[[], None]] = []

Batches = Iterable[pa.RecordBatch]


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir.  Where that is
    unset, a folder of this machine if all of Spark is in this one process, as in
    tests; on a cluster an error, as executors wouldn't see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there, and a
    lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.parquet(path)
    table.boxloom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.boxloom_path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, a written table of few columns, marked for broadcast if its rows,
    counted, allow it."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone (doc_id).  The ids are
    broadcast while their count allows it, so that no text is shuffled."""
    ids = written(gone.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(sized(ids), docs["doc_id"].eqNullSafe(ids["gone_id"]), "left_anti")


def frugal(run: Callable[[Batches], Iterator[pa.RecordBatch]], keep_caches: bool = False) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """run() for mapInArrow.  Spark keeps Python workers for later stages, and
    with them all they hold: caches of other operators go before the task, and
    freed memory goes back to the system after it."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        if not keep_caches:
            for empty in CACHES:
                empty()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes together; no text is split."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, min(n, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def slim_batches(batches: Batches, text: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of column `text`, so that
    what Python makes of a slice is bounded; a longer text is a slice of its own."""
    for b in batches:
        size = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        stop, lo = np.cumsum(size), 0
        while lo < b.num_rows:
            before = int(stop[lo] - size[lo])
            hi = max(lo + 1, int(np.searchsorted(stop, before + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ...: no name of an operator's own clashes."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def give_back() -> None:
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, group: Sequence[str], spread: Column, order: Sequence[str | Column], rows: int, name: str = "rank") -> DataFrame:
    """Adds name: the row's gapless 0-based number within its group.

    Each group is dealt over sub-groups by spread, the more the more rows df has;
    a window numbers each sub-group, and the counts of earlier sub-groups
    (groups * sub-groups rows) are added.  No task sees a whole group.
    """
    buckets = max(256, -(-rows // RANK_ROWS))
    cut = df.withColumn("_b", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = cut.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1)
    joined = inner.join(offsets, [*group, "_b"])
    return joined.withColumn(name, (F.col("_off") + F.col("_in")).cast("long")).drop("_b", "_in", "_off")
