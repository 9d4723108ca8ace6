"""Writers.  Manifests are DataFrames; files are written from the executors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import CLASS_NAMES

# The two directory layouts.
LAYOUTS = {"split_first": "{split}/{kind}", "kind_first": "{kind}/{split}"}


def destination(root: str, split: Column, kind: str, name: Column, layout: str) -> Column:
    first, second = (split, F.lit(kind)) if layout == "split_first" else (F.lit(kind), split)
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {sorted(LAYOUTS)}")
    return F.concat_ws("/", F.lit(root.rstrip("/")), first, second, name)


def split_manifest(items: DataFrame, root: str, layout: str = "split_first") -> DataFrame:
    """(src, dst, split, kind): image copies, and label copies where there is one."""
    image = items.select(F.col("path").alias("src"), destination(root, F.col("split"), "images", F.col("name"), layout).alias("dst"), "split", F.lit("images").alias("kind"))
    if "label_path" not in items.columns:
        return image
    label_name = F.concat("stem", F.lit(".txt"))
    label = items.where("label_path IS NOT NULL").select(F.col("label_path").alias("src"), destination(root, F.col("split"), "labels", label_name, layout).alias("dst"), "split", F.lit("labels").alias("kind"))
    return image.unionByName(label)


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def make_layout(root: str, splits: Sequence[str], layout: str = "split_first") -> list[str]:
    """Creates the folders; existing ones, and files in them, stay."""
    import os

    made = [f"{root.rstrip('/')}/{LAYOUTS[layout].format(split=s, kind=k)}" for s in splits for k in ("images", "labels")]
    for d in made:
        os.makedirs(d, exist_ok=True)
    return made


def copy_files(manifest: DataFrame, with_metadata: bool = False) -> None:
    """Copies src to dst on a shared file system, partition by partition.  A
    retried task writes the same bytes again."""

    def run(rows: Iterable) -> None:
        import os
        import shutil

        for r in rows:
            dst = _plain(r["dst"])
            os.makedirs(os.path.dirname(dst), exist_ok=True)
            (shutil.copy2 if with_metadata else shutil.copyfile)(_plain(r["src"]), dst)

    manifest.select("src", "dst").foreachPartition(run)


def write_labels(labels: DataFrame) -> None:
    """The text of each (dst, text) row at its path, on a shared file system."""

    def run(rows: Iterable) -> None:
        import os

        for r in rows:
            dst = _plain(r["dst"])
            os.makedirs(os.path.dirname(dst), exist_ok=True)
            with open(dst, "w", encoding="utf-8", newline="") as f:
                f.write(r["text"] or "")

    labels.select("dst", "text").foreachPartition(run)


def write_texts(texts: DataFrame, root: str, name: str = "stem") -> None:
    """``<root>/<name>.txt`` for each row; empty text leaves an empty file.
    Each name must be unique (see last_write_wins)."""

    def run(rows: Iterable) -> None:
        import os

        os.makedirs(_plain(root), exist_ok=True)
        for r in rows:
            with open(f"{_plain(root)}/{r[name]}.txt", "w", encoding="utf-8", newline="") as f:
                f.write(r["text"] or "")

    texts.select(name, "text").foreachPartition(run)


def dataset_config(root: str, classes: Sequence[str] = CLASS_NAMES, test: bool = False, count: bool = False) -> str:
    """YAML text: path, train, val, names; test and nc when asked for."""
    lines = [f"path: {root}", "train: images/train", "val: images/val"]
    lines += ["test: images/test"] * test + [f"nc: {len(classes)}"] * count
    return "\n".join([*lines, "", "names:", *(f"  {i}: {c}" for i, c in enumerate(classes))]) + "\n"
