"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Regions hold racks, racks hold shards; a node weighs what its shards weigh.  A
row descends level by level: among the regions the one of least draw
-ln(u) / weight wins, u from a hash of (key, level, node), then among that
region's racks, then among that rack's shards.  So a row takes as many hashes as
its path has siblings, not one a shard.

A changed weight moves rows only into or out of the subtrees that hold it: other
regions' draws stay as they were.  Shards added later each open a region of
their own, so they take rows only into themselves (law `key`): put beside the old
racks they would change an old region's weight, and rows drawn to it would
spread over its old shards.

Null keys hash as an absent value (all to one place); null texts have no bytes.
Repeated rows go to the same shard and get slots of their own; an empty table
gives an empty one.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import ranked, written

SHARDS_PER_RACK = 2
RACKS_PER_REGION = 4
ROW_OVERHEAD = 8


def draw(key: Column, level: str, node: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight; infinite for a weight of 0 or none."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def least(key: Column, level: str, nodes: Sequence[Column], weights: Sequence[Column], seed: int) -> Column:
    """The node of least draw; ties go to the first."""
    found = [F.struct(draw(key, level, n, w, seed).alias("draw"), n.alias("node")) for n, w in zip(nodes, weights, strict=True)]
    return (F.least(*found) if len(found) > 1 else found[0])["node"]


def sums(weights: Sequence[float], per: int) -> list[float]:
    return [sum(weights[i : i + per]) for i in range(0, len(weights), per)]


def descend(df: DataFrame, key: str, weights: Sequence[float], out: str, added: Sequence[float] = (), seed: int = 0) -> DataFrame:
    """Adds out: the shard of each row.  weights: of the tree's shards; added: of
    later ones, numbered on, each a region of its own.  Weights of 0 take no rows."""
    if not weights or min([*weights, *added]) < 0 or max([*weights, *added]) <= 0:
        raise ValueError("weights are at least 0, one is above")
    racks = sums(weights, SHARDS_PER_RACK)
    regions = [*sums(racks, RACKS_PER_REGION), *added]
    n, k = len(weights), F.col(key)

    def inner(level: str, parent: str, per: int, known: Sequence[float]) -> Column:
        nodes = [F.col(parent) * per + i for i in range(per)]
        table = F.array(*[F.lit(float(w)) for w in known])
        return least(k, level, nodes, [F.coalesce(F.get(table, x), F.lit(0.0)) for x in nodes], seed)

    df = df.withColumn("_region", least(k, "region", [F.lit(i) for i in range(len(regions))], [F.lit(float(w)) for w in regions], seed))
    df = df.withColumn("_rack", inner("rack", "_region", RACKS_PER_REGION, racks))
    df = df.withColumn("_leaf", inner("shard", "_rack", SHARDS_PER_RACK, weights))
    own = len(regions) - len(added)  # regions of the tree
    return df.withColumn(out, F.when(F.col("_region") >= own, F.col("_region") - own + n).otherwise(F.col("_leaf")).cast("int")).drop("_region", "_rack", "_leaf")


def assign_shards(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law 'key', shard, slot, grown_shard.

    grown_shard: the shard once there is one more, of weight 1.  Texts are read
    once; the narrow rows are written.
    """
    w = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = descend(descend(slim, "doc_id", w, "shard", seed=seed), "doc_id", w, "grown_shard", [1.0], seed)
    placed = written(placed, "shards")
    out = ranked(placed, ["shard"], F.struct("doc_id", "text_crc32"), ["doc_id", "text_crc32", "size"], placed.count(), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
