"""File listings as DataFrames.  Only metadata is read, never file content."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import refs


def _listing(spark: SparkSession, root: str, recursive: bool, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select("path", "modificationTime", "length")
    name = refs.basename(F.col("path"))
    return files.select("path", name.alias("name"), refs.stem_or_name(name).alias("stem"), F.col("modificationTime").alias("mtime"), "length")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """``*.jpg`` directly in root; the suffix is case-sensitive.

    Spark's listing hides names that begin with ``_`` or ``.``.
    """
    return _listing(spark, root, False, "*.jpg")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root, for the lookup of last resort."""
    return _listing(spark, root, True, None)


def list_labels(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, stem) of ``*.txt`` below root, empty files included.

    A scan leaves empty files out, but an empty label file says that its image
    shows nothing; so the names come from the file index, which the driver holds.
    """
    index = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    # the index gives encoded URLs, a scan plain paths
    paths = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in index.inputFiles()]
    name = refs.basename(F.col("path"))
    return spark.createDataFrame(paths, "path string").select("path", name.alias("name"), refs.stem_or_name(name).alias("stem"))


def list_videos(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """Video files directly in a folder (or the one file given), by path.

    The suffix ignores case.  With required=True an empty folder raises.
    """
    found = _listing(spark, path, False, None).where(refs.is_video_file(F.col("name")))
    if required and not found.head(1):
        raise ValueError(f"no video files in {path}")
    return found.orderBy("path")


def newest(listing: DataFrame) -> DataFrame:
    """The path that changed last; the largest path wins among equals."""
    return listing.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))
