"""Dataset splits with exact floor sizes and a reproducible order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators.ranking import hash_order, with_rank


def split_by_counts(df: DataFrame, key: str, parts: Sequence[tuple[str, float | None]], seed: int | str | None = 42) -> DataFrame:
    """Adds split.  parts: (name, ratio) from the front; the last, of ratio
    None, takes the rest.  Each part has floor(n * ratio) rows.

    Membership follows md5(seed, key), then key: the same on every run and
    under any partitioning.
    """
    if parts[-1][1] is not None or any(r is None or not 0 <= r <= 1 for _, r in parts[:-1]):
        raise ValueError("every part but the last has a ratio in [0, 1]")
    ranked = with_rank(df.withColumn("_h", F.coalesce(hash_order(F.col(key), seed), F.lit("0"))), "_h", [key])
    split, cut = None, F.lit(0)
    for name, ratio in parts[:-1]:
        cut = cut + F.floor(F.col("total") * F.lit(float(ratio)))
        here = F.col("rank") < cut
        split = F.when(here, name) if split is None else split.when(here, name)
    split = F.lit(parts[-1][0]) if split is None else split.otherwise(parts[-1][0])
    return ranked.withColumn("split", split).drop("_h", "rank", "total")


def three_way(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int | str | None = 0) -> DataFrame:
    return split_by_counts(df, key, [("train", train), ("val", val), ("test", None)], seed)


def val_first(df: DataFrame, key: str, val_split: float = 0.2, seed: int | str | None = 42) -> DataFrame:
    if not 0 <= val_split < 1:
        raise ValueError("val_split is in [0, 1)")
    return split_by_counts(df, key, [("val", val_split), ("train", None)], seed)


def train_first(df: DataFrame, key: str, ratio: float = 0.8, seed: int | str | None = 0) -> DataFrame:
    return split_by_counts(df, key, [("train", ratio), ("val", None)], seed)
