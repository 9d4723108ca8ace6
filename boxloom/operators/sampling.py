"""Frame plans: which frames of which video to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import timecode as T


def windows(videos: DataFrame, start: float | None = None, end: float | None = None, step: int = T.DEFAULT_STEP) -> DataFrame:
    """videos + first, last (exclusive), expected; null for an empty range."""
    if step < 1:
        raise ValueError("step is 1 at least")
    if start is not None and end is not None and end <= start:
        raise ValueError("end must be after start")
    as_col = lambda v: F.lit(v).cast("double")
    first, last = T.frame_bounds(F.col("total_frames"), F.col("fps"), as_col(start), as_col(end), F.col("already_trimmed"))
    out = videos.withColumn("first", first).withColumn("last", last)
    return out.withColumn("expected", T.expected_frames(F.col("first"), F.col("last"), step))


def frame_plan(windowed: DataFrame, step: int = T.DEFAULT_STEP) -> DataFrame:
    """A row a kept frame.  The stride counts from the window's start; indices
    come from sequence(), so no frame is made and then dropped."""
    idx = F.sequence(F.col("first"), F.col("last") - 1, F.lit(step).cast("long"))
    kept = windowed.where("last > first").select("stem", F.explode(idx).alias("frame_idx"))
    return kept.withColumn("file_name", T.frame_name(F.col("stem"), F.col("frame_idx")))
