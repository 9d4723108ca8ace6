"""Extension: the converter on streams of JSON-lines exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.operators import convert
from boxloom.sources import exports


def stream_label_texts(spark: SparkSession, folder: str, mode: str = "all") -> DataFrame:
    """New JSON-lines files -> label texts, row by row (no state needed)."""
    raw = spark.readStream.format("text").load(folder)
    tasks = raw.where(F.trim("value") != "").select(F.lit("stream").alias("file"), F.xxhash64("value").alias("ordinal"), F.col("value").alias("raw"))
    return convert.label_texts(exports.full_tasks(tasks, mode), clamp=mode == "all", zero_missing=mode == "all", keep_empty=True)


def stream_status_counts(texts: DataFrame) -> DataFrame:
    """Running counters of annotated and empty tasks (complete mode)."""
    return texts.groupBy((F.col("n_lines") > 0).alias("has_lines")).agg(F.count("*").alias("n"))
