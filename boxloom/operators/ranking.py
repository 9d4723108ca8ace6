"""Exact global ranks without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int | str | None = None) -> Column:
    """A fixed pseudo-random order: md5 of seed and key, as hex text."""
    text = key.cast("string")
    return F.md5(text if seed is None else F.concat(F.lit(f"{seed}:"), text))


def with_rank(df: DataFrame, order: str, ties: Sequence[str], digits: int = 3) -> DataFrame:
    """Adds rank (0-based, by hex column order then ties) and total.

    Rows go to 16**digits buckets by the head of their hash; a bucket's offset
    is the count before it (a table of 16**digits rows), so each window sorts
    one bucket only and no task sees all rows.
    """
    cut = df.withColumn("_b", F.substring(order, 1, digits))
    counts = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"), F.sum("_n").over(every).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order, *ties)) - 1
    ranked = cut.withColumn("_in", inside).join(F.broadcast(offsets), "_b")  # at most 16**digits rows
    return ranked.withColumn("rank", (F.col("_off") + F.col("_in")).cast("long")).drop("_b", "_off", "_in")
