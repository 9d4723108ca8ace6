"""Boxes: class ids, percent-to-fraction mapping, clamping, label lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The class vocabulary; position is the class id.
CLASS_NAMES = ("Red Alliance Robot", "Blue Alliance Robot")


def class_id(label: Column, classes: Sequence[str] = CLASS_NAMES) -> Column:
    """Zero-based position of label in classes; null when unknown or null."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.nullif(F.array_position(names, label), F.lit(0)).cast("int") - F.lit(1)


def clamp01(v: Column) -> Column:
    """v cut to [0, 1].  Null and NaN pass through, so that a missing value
    never turns into a coordinate of zero."""
    return F.when(v.isNull() | F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def centre_box(x: Column, y: Column, width: Column, height: Column, clamp: bool = True) -> dict[str, Column]:
    """Percent, top-left origin -> fractions, centre origin.

    The division order is part of the result (bit equality).  cx and cy use the
    width and height before they are clamped.
    """
    w, h = width / F.lit(100.0), height / F.lit(100.0)
    out = {"cx": x / F.lit(100.0) + w / F.lit(2.0), "cy": y / F.lit(100.0) + h / F.lit(2.0), "w": w, "h": h}
    return {k: clamp01(v) for k, v in out.items()} if clamp else out


def fixed6(v: Column) -> Column:
    """Six decimals of the exact binary value, ties to even.

    ``format_string('%.6f')`` rounds the shortest decimal half up, which gives
    another last digit on ties; ``format_number`` does not.
    """
    return F.call_function("format_number", v, F.lit("0.000000"))


def label_line(cid: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """``class cx cy w h``; null when any part is null."""
    parts = [cid.cast("string")]
    for v in (cx, cy, w, h):
        parts += [F.lit(" "), fixed6(v)]
    return F.concat(*parts)
