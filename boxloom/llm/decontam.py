"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides hash every GRAM-word run; of each SPAN neighbouring hashes the least
is a fingerprint.  GRAM + SPAN - 1 words are one window (13), so any window that
two texts share yields a fingerprint that both have.  Documents that share a
fingerprint with an item are candidates; their windows are then matched with the
items' windows and the hits extended to the words they cover.  Items shorter
than a window are windows of their own length, found by hashes of that length
(of the few lengths that occur).

Run hashes are built by doubling (1, 2, 4, 8 words), inside the row.  No text is
shuffled for the fingerprints; the benchmark's side is broadcast while its size,
counted first, allows it, and shuffled otherwise.

explode_outer, not explode: for the latter the optimizer infers a filter on the
exploded array and copies the whole nested expression into it.

Null texts have no words.  Items without an id or words are ignored, rows of one
item_id are one item.  Documents are told apart by doc_id and text, so repeated
rows, equal or not, are each answered.  Only doc_id, text and item_id are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import sized, written

WINDOW = 13
GRAM = 8
SPAN = WINDOW - GRAM + 1
BROADCAST_ROWS = 500_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGS = "array<bigint>"


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    some = F.coalesce(text, F.lit(""))
    plain = F.char_length(some) == F.octet_length(some)
    return F.when(plain, F.lower(some)).otherwise(F.translate(some, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAKS), "")


def _runs(n: Column, length: int, f) -> Column:
    """f(i) for each start i of a run of `length` words."""
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), f)).otherwise(F.array().cast(LONGS))


def _pair(a: Column, apart: int, *seed: Column):
    return lambda i: F.xxhash64(F.get(a, i), F.get(a, i + apart), *seed)


def with_hashes(df: DataFrame, most: int = GRAM) -> DataFrame:
    """Adds n_words and _h1, _h2, _h4, _h8: hashes of the runs of that length."""
    df = df.withColumn("_words", words_of(F.col("text"))).withColumn("n_words", F.size("_words"))
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    half = 1
    while half < most:
        df = df.withColumn(f"_h{2 * half}", _runs(F.col("n_words"), 2 * half, _pair(F.col(f"_h{half}"), half)))
        half *= 2
    return df


def run_hash(length: int) -> Column:
    """Array of the hashes of all runs of `length` words, from two overlapping
    runs of the power of two below it."""
    part = 1 << (length.bit_length() - 1)
    return _runs(F.col("n_words"), length, _pair(F.col(f"_h{part}"), length - part, F.lit(length)))


def _at(length: int):
    return lambda h, i: F.struct(i.alias("pos"), F.lit(length).alias("length"), h.alias("hash"))


def fingerprints(df: DataFrame) -> DataFrame:
    """Adds _prints: the distinct winnowed hashes of the row's text."""
    n = F.col("n_words")
    df = df.withColumn("_m2", _runs(n, GRAM + 1, lambda i: F.least(F.get("_h8", i), F.get("_h8", i + 1))))
    df = df.withColumn("_m4", _runs(n, GRAM + 3, lambda i: F.least(F.get("_m2", i), F.get("_m2", i + 2))))
    least = _runs(n, GRAM + SPAN - 1, lambda i: F.least(F.get("_m4", i), F.get("_m4", i + SPAN - 4)))
    return df.withColumn("_prints", F.array_distinct(least))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, hash), written once."""
    items = with_hashes(benchmark.where("item_id IS NOT NULL").select("item_id", "text")).where("n_words > 0")
    hashes = F.when(F.col("n_words") >= window, run_hash(window))
    for k in range(1, window):
        hashes = hashes.when(F.col("n_words") == k, run_hash(k))
    return items.select("item_id", F.least("n_words", F.lit(window)).alias("length"), F.explode_outer(hashes).alias("hash")).distinct()


def document_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids, comma-joined)."""
    docs = docs.select("doc_id", "text").withColumn("_text", F.xxhash64("text"))
    windows = written(item_windows(benchmark), "windows")
    short = sorted(r["length"] for r in windows.select("length").distinct().collect() if r["length"] < WINDOW)  # 12 at most
    prints = fingerprints(with_hashes(benchmark.where("item_id IS NOT NULL").select("item_id", "text"))).select(F.explode_outer("_prints").alias("hash"))
    prints = written(prints.unionByName(windows.where(F.col("length") < WINDOW).select("hash")).distinct(), "prints")

    marks = F.col("_prints")
    for k in short:
        marks = F.concat(marks, F.array_distinct(run_hash(k)))
    seen = fingerprints(with_hashes(docs)).select("doc_id", "_text", F.explode_outer(marks).alias("hash"))
    wanted = seen.join(sized(prints, BROADCAST_ROWS), "hash", "left_semi").select("doc_id", "_text").distinct()
    candidates = written(wanted, "candidates")

    near = sized(candidates.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")), BROADCAST_ROWS)
    chosen = docs.join(near, docs["doc_id"].eqNullSafe(near["_id"]) & (docs["_text"] == near["_t"]), "left_semi").distinct()
    spans = [F.transform(run_hash(k), _at(k)) for k in [*short, WINDOW]]
    runs = with_hashes(chosen).select("doc_id", "_text", F.explode_outer(F.concat(*spans) if len(spans) > 1 else spans[0]).alias("r")).select("doc_id", "_text", "r.*")
    hits = runs.join(sized(windows, BROADCAST_ROWS), ["hash", "length"])
    # a document's positions and items: bounded by its length and the benchmark
    per_item = hits.groupBy("doc_id", "_text").agg(F.sort_array(F.collect_set(F.struct("pos", "length"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))

    def cover(acc: Column, s: Column) -> Column:
        stop = s["pos"] + s["length"]
        return F.struct(F.greatest(acc["stop"], stop).alias("stop"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["stop"], s["pos"]))).alias("n"))

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")), cover, lambda a: a["n"])
    found = per_item.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), covered.alias("n_hit"), F.size("ids").alias("n_items"), F.array_join("ids", ",").alias("items"))
    every = docs.select("doc_id", "_text", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(found, every["doc_id"].eqNullSafe(found["_id"]) & (every["_text"] == found["_t"]), "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_words", whole("n_hit"), whole("n_items"), F.coalesce("items", F.lit("")).alias("items"), "_text")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = document_hits(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns, which may have
    any name."""
    bad = document_hits(docs, benchmark).where(contaminated()).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).distinct()
    bad = written(bad, "contaminated")
    return docs.join(sized(bad), docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""
