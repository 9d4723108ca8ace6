"""Tasks -> boxes -> label lines -> label text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import geometry as G

RECTANGLE = "rectanglelabels"


def explode_boxes(tasks: DataFrame, keys: Sequence[str] = ("file", "ordinal")) -> DataFrame:
    """A row a box, with its position; tasks without boxes give none."""
    return tasks.select(*keys, F.posexplode("boxes").alias("pos", "box"))


def box_status(kind: Column, label: Column, has_label: Column, numbers: Column) -> Column:
    """'ok', or why a box is left out; tested in this order."""
    return (
        F.when(~F.coalesce(kind == RECTANGLE, F.lit(False)), "not_rectangle")
        .when(~has_label, "no_label")
        .when(G.class_id(label).isNull(), "unknown_label")
        .when(~numbers, "bad_number")
        .otherwise("ok")
    )


def box_lines(boxes: DataFrame, clamp: bool = True, zero_missing: bool = False) -> DataFrame:
    """Adds status, class_id, cx, cy, w, h and line to exploded boxes.

    zero_missing: an absent coordinate counts as 0 (full exports, mode "all").
    line is null unless status is 'ok'.
    """
    label = F.get("box.labels", F.lit(0))
    sides = {}
    for k in ("x", "y", "width", "height"):
        raw = F.col(f"box.{k}_raw")
        v = F.col(f"box.{k}")
        if zero_missing:
            v = F.when(raw == "", F.coalesce(v, F.lit(0.0))).otherwise(v)
        sides[k] = v
    numbers = F.lit(True)
    for v in sides.values():
        numbers = numbers & v.isNotNull()
    status = box_status(F.col("box.kind"), label, F.coalesce(F.size("box.labels") > 0, F.lit(False)), numbers)
    out = boxes.withColumn("status", status).withColumn("class_id", G.class_id(label))
    out = out.withColumns(G.centre_box(sides["x"], sides["y"], sides["width"], sides["height"], clamp))
    line = G.label_line(F.col("class_id"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return out.withColumn("line", F.when(F.col("status") == "ok", line)).drop("box")


def collect_lines(lines: DataFrame, keys: Sequence[str], order: Sequence[str], final_newline: bool = True) -> DataFrame:
    """Label text of each key: its lines in the given order.

    collect_list keeps no order, so the order columns travel in the struct.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, "line")))
    out = lines.where(F.col("line").isNotNull()).groupBy(*keys).agg(items.alias("items"))
    text = F.array_join(F.transform("items", lambda i: i["line"]), "\n")
    return out.select(*keys, F.size("items").alias("n_lines"), (F.concat(text, F.lit("\n")) if final_newline else text).alias("text"))


def lines_in_row(boxes: Column, clamp: bool, zero_missing: bool) -> Column:
    """Lines of one task without leaving its row: no shuffle for array input."""

    def one(b: Column) -> Column:
        side = {}
        for k in ("x", "y", "width", "height"):
            side[k] = F.when(b[f"{k}_raw"] == "", F.coalesce(b[k], F.lit(0.0))).otherwise(b[k]) if zero_missing else b[k]
        box = G.centre_box(side["x"], side["y"], side["width"], side["height"], clamp)
        line = G.label_line(G.class_id(F.get(b["labels"], F.lit(0))), box["cx"], box["cy"], box["w"], box["h"])
        return F.when(b["kind"] == RECTANGLE, line)

    return F.filter(F.transform(boxes, one), lambda x: x.isNotNull())


def label_texts(tasks: DataFrame, clamp: bool, zero_missing: bool, keep_empty: bool) -> DataFrame:
    """(file, ordinal, image_ref, n_lines, text).

    keep_empty: a task without lines stays, with empty text (file-per-task
    layout); otherwise it goes (dataset layout).
    """
    out = tasks.withColumn("lines", lines_in_row(F.col("boxes"), clamp, zero_missing))
    text = F.when(F.size("lines") > 0, F.concat(F.array_join("lines", "\n"), F.lit("\n"))).otherwise(F.lit(""))
    out = out.select("file", "ordinal", "image_ref", "annotated", F.size("lines").alias("n_lines"), text.alias("text"))
    return out if keep_empty else out.where("n_lines > 0")


def last_write_wins(texts: DataFrame, name: str = "stem", order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """One text per output name: the last written; n_writes counts collisions."""
    return texts.groupBy(name).agg(F.max_by("text", F.struct(*order)).alias("text"), F.count("*").alias("n_writes"))


def run_counters(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))
