"""Videos: the metadata table, an optional probe, and the fetch command.

There is no video decoder among Spark's sources.  A frame plan needs only
(path, total_frames, fps), which any catalogue can supply; probe() fills it in
where the optional decoder package is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import refs
from boxloom.functions.timecode import DEFAULT_STEP, clock_text

PROBE_SCHEMA = "path string, total_frames int, fps double"


def videos(table: DataFrame) -> DataFrame:
    """Normalised video items from (path, total_frames, fps[, already_trimmed])."""
    trimmed = F.col("already_trimmed") if "already_trimmed" in table.columns else F.lit(False)
    return table.select(
        "path",
        refs.stem_or_name(refs.basename(F.col("path"))).alias("stem"),
        F.coalesce("total_frames", F.lit(0)).cast("int").alias("total_frames"),
        F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(30.0)).alias("fps"),
        F.coalesce(trimmed, F.lit(False)).alias("already_trimmed"),
    )


def probe(paths: DataFrame) -> DataFrame:
    """Frame count and rate of each file; files that don't open give 0 frames."""

    def look(batches: Iterator) -> Iterator:
        import cv2  # optional decoder
        import pandas as pd

        for batch in batches:
            rows = []
            for p in batch["path"]:
                cap = cv2.VideoCapture(str(p).removeprefix("file:"))
                known = cap.isOpened()
                rows.append((p, int(cap.get(cv2.CAP_PROP_FRAME_COUNT)) if known else 0, float(cap.get(cv2.CAP_PROP_FPS)) if known else 0.0))
                cap.release()
            yield pd.DataFrame(rows, columns=["path", "total_frames", "fps"])

    return paths.select("path").mapInPandas(look, PROBE_SCHEMA)


def fetch_command(url: str, folder: str, start: float | None = None, end: float | None = None) -> list[str]:
    """Arguments of the external downloader; nothing is run here.

    A slice is asked for only when both bounds are given.
    """
    # The downloader's options and format choice.
    out = [
        "yt-dlp",
        "-f", "bv*[ext=mp4]+ba[ext=m4a]/b[ext=mp4]/bv*+ba/b",
        "--merge-output-format", "mp4",
        "-o", f"{folder.rstrip('/')}/%(id)s.%(ext)s",
        "--no-playlist",
        "--no-warnings",
        "--print", "after_move:filepath",
    ]
    if start is not None and end is not None:
        out += ["--download-sections", f"*{clock_text(start)}-{clock_text(end)}", "--force-keyframes-at-cuts"]
    return [*out, url]


def fetched_path(printed: str) -> str | None:
    """Last line the downloader printed; None sends the caller to the newest file."""
    return printed.rstrip().rpartition("\n")[2].strip() or None


def decode_jpeg(path: str, wanted: list[int]) -> Iterator[tuple[int, bytes | None]]:
    """(index, JPEG bytes, or None where the frame can't be read)."""
    import cv2  # optional decoder

    cap = cv2.VideoCapture(path)
    try:
        for i in wanted:
            cap.set(cv2.CAP_PROP_POS_FRAMES, i)
            read, frame = cap.read()
            done, data = cv2.imencode(".jpg", frame) if read else (False, None)
            yield i, data.tobytes() if done else None
    finally:
        cap.release()


def write_frames(windowed: DataFrame, root: str, step: int = DEFAULT_STEP, decode: Callable[[str, list[int]], Iterator[tuple[int, bytes | None]]] = decode_jpeg) -> DataFrame:
    """Writes the kept frames of sampling.windows() into root, a shared folder, as
    <stem>_f<index>.jpg; (path, expected, saved) of each video.  Frames that don't
    decode are left out.  A task is a video; a retried one writes the same again."""

    def run(batches: Iterator) -> Iterator:
        import os

        import pandas as pd

        os.makedirs(root, exist_ok=True)
        for batch in batches:
            rows = []
            for v in batch.itertuples():
                indices = list(range(int(v.first), int(v.last), step)) if v.last > v.first else []
                saved = 0
                for i, data in decode(v.path.removeprefix("file://").removeprefix("file:"), indices):
                    if data is not None:
                        with open(f"{root}/{v.stem}_f{i:07d}.jpg", "wb") as f:
                            f.write(data)
                        saved += 1
                rows.append((v.path, len(indices), saved))
            yield pd.DataFrame(rows, columns=["path", "expected", "saved"])

    return windowed.select("path", "stem", "first", "last").repartition("path").mapInPandas(run, "path string, expected long, saved long")


def object_store_images(spark, refs_df: DataFrame, column: str = "image_ref") -> DataFrame:
    """Download plan for ``gs://bucket/blob``: (bucket, blob, dst, ok)."""
    bucket, blob = refs.bucket_and_blob(F.col(column))
    return refs_df.select(column, bucket.alias("bucket"), blob.alias("blob"), F.concat(F.lit("images/"), refs.basename(blob)).alias("dst"), blob.isNotNull().alias("ok"))
