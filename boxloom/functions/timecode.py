"""Time codes and frame arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

DEFAULT_FPS = 30.0
DEFAULT_STEP = 12


def parse_time(text: Column) -> Column:
    """``S``, ``M:S`` or ``H:M:S`` -> seconds.  Null for null, blank or bad text.

    nan, inf and underscores in numbers count as bad, as does a negative total.
    """
    parts = F.split(F.trim(text), ":", -1)
    fine = F.forall(parts, lambda p: p.rlike(_NUMBER))
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    total = (
        F.when(F.size(parts) == 1, at(0))
        .when(F.size(parts) == 2, at(0) * F.lit(60.0) + at(1))
        .when(F.size(parts) == 3, at(0) * F.lit(3600.0) + at(1) * F.lit(60.0) + at(2))
    )
    return F.when(fine & (total >= 0), total)


def time_error(text: Column) -> Column:
    """True where the text is neither absent nor a time."""
    absent = text.isNull() | (F.trim(text) == "")
    return ~absent & parse_time(text).isNull()


def format_time(seconds: Column) -> Column:
    """``H:MM:SS.mmm``; a fraction that rounds up may print 60.000."""
    h = F.floor(seconds / F.lit(3600.0))
    m = F.floor((seconds % F.lit(3600.0)) / F.lit(60.0))
    s = F.call_function("format_number", seconds % F.lit(60.0), F.lit("00.000"))
    return F.concat(h.cast("string"), F.lit(":"), F.format_string("%02d", m), F.lit(":"), s)


def clock_text(seconds: float) -> str:
    """What format_time gives, for one number."""
    minutes, rest = divmod(seconds, 60.0)
    return "{}:{:02d}:{:06.3f}".format(*divmod(int(minutes), 60), rest)


def section(start: Column, end: Column) -> Column:
    """``*start-end``; null unless both bounds are given."""
    return F.concat(F.lit("*"), format_time(start), F.lit("-"), format_time(end))


def frame_at(seconds: Column, fps: Column) -> Column:
    """Nearest frame, ties to even."""
    return F.rint(seconds * fps).cast("long")


def frame_bounds(total: Column, fps: Column, start: Column, end: Column, trimmed: Column) -> tuple[Column, Column]:
    """First frame and the frame after the last one; both null for an empty
    time range.  A clip that was trimmed already is used whole."""
    rate = F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(DEFAULT_FPS))
    length = F.when(rate > 0, total / rate).otherwise(F.lit(0.0))
    s, e = F.coalesce(start, F.lit(0.0)), F.coalesce(end, length)
    first = F.when(trimmed, F.lit(0).cast("long")).when(e > s, frame_at(s, rate))
    last = F.when(trimmed, total.cast("long")).when(e > s, F.least(total.cast("long"), frame_at(e, rate)))
    return first, last


def expected_frames(first: Column, last: Column, step: int = DEFAULT_STEP) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor((last - first + F.lit(step - 1)) / F.lit(float(step))))


def frame_name(stem: Column, idx: Column) -> Column:
    number = F.when(idx < 10_000_000, F.lpad(idx.cast("string"), 7, "0")).otherwise(idx.cast("string"))  # plainer than format_string
    return F.concat(stem, F.lit("_f"), number, F.lit(".jpg"))
