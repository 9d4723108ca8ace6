"""Annotation exports: full JSON, JSON-MIN, and JSON lines for scale.

One task row: (file, ordinal, image_ref, annotated, boxes) with
boxes = array<struct<kind, x, y, width, height, labels>> in document order.
Numbers and flags are read tolerantly through VARIANT, so "10" counts as 10 and
1 as true; anything else becomes null and is counted as rejected later, never
drawn as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import refs


def read_tasks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, ordinal, task): one variant per task of each export.

    A whole-array export is one task per file, so many files run in parallel;
    for one huge export use lines=True, a JSON object a line, which splits.
    A file that isn't a JSON array raises; it does not read as empty.
    """
    if lines:
        raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
        raw = raw.withColumn("ordinal", F.monotonically_increasing_id())
        return raw.where(F.trim("value") != "").select("file", "ordinal", F.col("value").alias("raw"))
    whole = spark.read.text(path, wholetext=True)
    return tasks_of(whole.select(F.col("_metadata.file_path").alias("file"), "value"))


def tasks_of(texts: DataFrame) -> DataFrame:
    """(file, value) with a JSON array each -> (file, is_min, ordinal, raw); the
    first element says for its file whether it is JSON-MIN."""
    # The variant parse fails on truncated text, which the array parse hides.
    valid = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("[")
    items = F.when(valid, F.from_json("value", "array<string>")).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("file"))).cast("array<string>")
    )
    first = F.get("items", F.lit(0))
    flag = has_key(first, "label") & ~has_key(first, "annotations")
    return texts.select("file", items.alias("items")).select("file", flag.alias("is_min"), F.posexplode("items").alias("ordinal", "raw"))


def has_key(raw: Column, key: str) -> Column:
    """Whether a JSON object has the key, null values included."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))


def is_min_format(tasks: DataFrame) -> DataFrame:
    """(file, is_min): the first element decides for its whole file."""
    first = tasks.where(F.col("ordinal") == 0)
    return first.select("file", (has_key(F.col("raw"), "label") & ~has_key(F.col("raw"), "annotations")).alias("is_min"))


def _num(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def _value_box(v: Column, base: str, kind: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        *[_num(v, f"{base}.{k}").alias(k) for k in ("x", "y", "width", "height")],
        *[F.coalesce(F.try_variant_get(v, f"{base}.{k}", "string"), F.lit("")).alias(f"{k}_raw") for k in ("x", "y", "width", "height")],
        F.try_variant_get(v, f"{base}.rectanglelabels", "array<string>").alias("labels"),
    )


def _task(raw: Column) -> Column:
    return F.try_parse_json(raw)


def full_tasks(tasks: DataFrame, mode: str = "all", ref: str | None = None) -> DataFrame:
    """Full exports.

    mode "first": results of the first annotation, cancelled or not.
    mode "all": results of every annotation that isn't cancelled, in order.
    ref: key of data that holds the image; None takes its first string value.
    """
    if mode not in ("first", "all"):
        raise ValueError("mode is 'first' or 'all'")
    v = F.col("task")
    anns = F.coalesce(F.try_variant_get(v, "$.annotations", "array<variant>"), F.array().cast("array<variant>"))
    results = lambda a: F.coalesce(F.try_variant_get(a, "$.result", "array<variant>"), F.array().cast("array<variant>"))
    if mode == "first":
        chosen = F.slice(anns, 1, 1)
    else:
        chosen = F.filter(anns, lambda a: ~F.coalesce(F.try_variant_get(a, "$.was_cancelled", "boolean"), F.lit(False)))
    flat = F.flatten(F.transform(chosen, results))
    boxes = F.transform(flat, lambda r: _value_box(r, "$.value", F.try_variant_get(r, "$.type", "string")))
    data = F.get_json_object("raw", "$.data")
    data = F.when(F.startswith(F.trim(data), F.lit("{")), data)
    image = refs.first_string_value(data) if ref is None else F.coalesce(F.try_variant_get(v, f"$.data.{ref}", "string"), F.lit(""))
    return tasks.withColumn("task", _task(F.col("raw"))).select(
        "file", "ordinal", image.alias("image_ref"), (F.size(anns) > 0).alias("annotated"), boxes.alias("boxes")
    )


def min_tasks(tasks: DataFrame) -> DataFrame:
    """JSON-MIN exports: image (or img) and label."""
    v = F.col("task")
    text = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    labels = F.coalesce(F.try_variant_get(v, "$.label", "array<variant>"), F.array().cast("array<variant>"))
    boxes = F.transform(labels, lambda b: _value_box(b, "$", F.lit("rectanglelabels")))
    return tasks.withColumn("task", _task(F.col("raw"))).select(
        "file", "ordinal", F.coalesce(text("image"), text("img"), F.lit("")).alias("image_ref"), (F.size(labels) > 0).alias("annotated"), boxes.alias("boxes")
    )


def read_export(spark: SparkSession, path: str, mode: str = "all", ref: str | None = None, lines: bool = False) -> DataFrame:
    """Tasks of any mix of full and JSON-MIN files; each file's first element
    says which it is."""
    tasks = read_tasks(spark, path, lines)
    if lines:  # an object a line: each line tells for itself
        is_min = has_key(F.col("raw"), "label") & ~has_key(F.col("raw"), "annotations")
        marked = tasks.withColumn("is_min", is_min)
    else:
        marked = tasks
    return full_tasks(marked.where("NOT is_min"), mode, ref).unionByName(min_tasks(marked.where("is_min")))
