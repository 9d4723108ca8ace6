"""End to end: exports + images -> split dataset, as lazy tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import refs
from boxloom.functions.geometry import CLASS_NAMES
from boxloom.operators import convert, match, splits
from boxloom.sources import exports, listing, sinks


@dataclass
class Dataset:
    items: DataFrame  # task_id, path, name, stem, text, split
    status: DataFrame  # status, n
    manifest: DataFrame  # src, text, dst, split, kind: image copies and label files


def convert_dataset(spark: SparkSession, export: str, images: str, out: str, val_split: float = 0.2, seed: int = 42, lines: bool = False) -> Dataset:
    """Dataset layout: all annotations that aren't cancelled, clamped boxes,
    tasks without image or boxes dropped and counted, val cut first."""
    if not 0 <= val_split < 1:
        raise ValueError("val_split is in [0, 1)")
    must_exist(spark, export, images)
    tasks = exports.read_export(spark, export, "all", lines=lines)
    texts = convert.label_texts(tasks, clamp=True, zero_missing=True, keep_empty=True)
    texts = texts.withColumn("task_id", F.concat_ws("#", "file", "ordinal"))
    matched = match.match_images(texts, listing.list_images(spark, images), listing.list_tree(spark, images))
    matched = matched.withColumn("status", match.task_status())
    good = matched.where("status = 'ok'").withColumn("name", refs.basename(F.col("path")))
    good = good.withColumn("stem", refs.stem_or_name(F.col("name")))
    items = splits.val_first(good.select("task_id", "path", "name", "stem", "ordinal", "text"), "task_id", val_split, seed)
    return Dataset(items, convert.run_counters(matched), dataset_manifest(items, out))


def dataset_manifest(items: DataFrame, out: str, layout: str = "kind_first") -> DataFrame:
    """(src, text, dst, split, kind): each image copy has a src, each label file a
    text.  Tasks that come to one file in a split write it once, the last task
    (by task_id) wins; images that differ in their suffix only share a label."""
    last = lambda c: F.max_by(c, F.struct("ordinal", "task_id")).alias(c)
    images = items.groupBy("split", "name").agg(last("path"))
    labels = items.groupBy("split", "stem").agg(last("text"))
    image = images.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("text"), sinks.destination(out, F.col("split"), "images", F.col("name"), layout).alias("dst"), "split", F.lit("images").alias("kind"))
    name = F.concat("stem", F.lit(".txt"))
    label = labels.select(F.lit(None).cast("string").alias("src"), "text", sinks.destination(out, F.col("split"), "labels", name, layout).alias("dst"), "split", F.lit("labels").alias("kind"))
    return image.unionByName(label)


def write_dataset(dataset: Dataset, out: str, classes: Sequence[str] = CLASS_NAMES) -> dict[str, int]:
    """Folders, images, label files and data.yaml in out, a shared folder; returns
    the image count of each split.  A dataset without items raises."""
    import os

    counts = {r["split"]: r["n"] for r in dataset.manifest.where("kind = 'images'").groupBy("split").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts:
        raise ValueError("no usable annotations: check the export and the image folder")
    sinks.make_layout(out, ("train", "val"), "kind_first")
    sinks.copy_files(dataset.manifest.where("kind = 'images'"), with_metadata=True)
    sinks.write_labels(dataset.manifest.where("kind = 'labels'"))
    with open(f"{out}/data.yaml", "w", encoding="utf-8") as f:
        f.write(sinks.dataset_config(os.path.abspath(out), classes))
    return counts


def must_exist(spark: SparkSession, *paths: str) -> None:
    """Raises for a path that its file system doesn't have."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
            raise FileNotFoundError(p)


def convert_labels(spark: SparkSession, export: str, lines: bool = False) -> DataFrame:
    """File-per-task layout: first annotation, no clamp, empty text kept, last
    task wins where stems collide.  (stem, text, n_writes)"""
    tasks = exports.read_export(spark, export, "first", ref="image", lines=lines)
    texts = convert.label_texts(tasks, clamp=False, zero_missing=False, keep_empty=True)
    name = refs.basename(F.col("image_ref"))
    return convert.last_write_wins(texts.withColumn("stem", refs.stem_or_name(name)), order=("file", "ordinal"))
