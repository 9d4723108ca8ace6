"""Annotation references against image files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import refs


def with_candidates(tasks: DataFrame, ref: str = "image_ref") -> DataFrame:
    """(…, name, priority, candidate): raw name first, then the stripped one."""
    name = refs.image_name(F.col(ref))
    return tasks.withColumn("name", name).select("*", F.posexplode(refs.candidate_names(F.col("name"))).alias("priority", "candidate"))


def match_exact(tasks: DataFrame, images: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, path): file directly in the image folder; first candidate wins.

    An empty name matches nothing.  Equi-join; Spark broadcasts the listing
    only while it is below the session's threshold.
    """
    files = images.groupBy(F.col("name").alias("candidate")).agg(F.min("path").alias("path"))
    hits = with_candidates(tasks).where("candidate <> ''").join(files, "candidate")
    return hits.groupBy(key).agg(F.min_by("path", "priority").alias("path"))


def match_suffix(missed: DataFrame, tree: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, path): a file anywhere below the root whose name ends in the
    candidate; candidate order first, then the smallest path.

    The suffix test becomes an equi-join: each file name is expanded into the
    suffixes whose length some wanted candidate has, so no nested loop over
    files x tasks remains and each file adds at most its own length in rows.
    """
    wanted = with_candidates(missed).where("candidate <> ''").select(key, "priority", "candidate")
    size = F.length("name")
    cut = F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).alias("n")
    lengths = wanted.select(F.length("candidate").alias("n")).distinct()
    tails = tree.where("name <> ''").select("path", "name", cut).join(lengths, "n").select("path", F.expr("right(name, n)").alias("candidate"))
    best = tails.groupBy("candidate").agg(F.min("path").alias("path"))
    return wanted.join(best, "candidate").groupBy(key).agg(F.min_by("path", "priority").alias("path"))


def match_images(tasks: DataFrame, images: DataFrame, tree: DataFrame | None = None, key: str = "task_id") -> DataFrame:
    """tasks + path (null where missing): exact join, then the suffix lookup
    for what is left only."""
    exact = match_exact(tasks, images, key)
    found = exact
    if tree is not None:
        rest = tasks.join(exact, key, "left_anti")
        found = exact.unionByName(match_suffix(rest, tree, key))
    return tasks.join(found, key, "left")


def missing_images(tasks: DataFrame, matched: DataFrame, key: str = "task_id") -> DataFrame:
    return tasks.join(matched.where("path IS NOT NULL").select(key), key, "left_anti")


def with_sidecar(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the label file of the same stem, if there is one."""
    side = labels.groupBy("stem").agg(F.min("path").alias("label_path"))
    return images.join(side, "stem", "left")


def task_status(path: str = "path", n_lines: str = "n_lines"):
    """'skipped_missing' is tested before 'skipped_empty'."""
    return F.when(F.col(path).isNull(), "skipped_missing").when(F.coalesce(F.col(n_lines), F.lit(0)) == 0, "skipped_empty").otherwise("ok")
