"""python -m boxloom convert | labels | sample | split"""

from __future__ import annotations

import argparse

from boxloom.operators import match, sampling, splits
from boxloom.plans import dataset
from boxloom.session import local_session
from boxloom.sources import listing, sinks, video


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="boxloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("convert", help="an export and its images to a split dataset")
    p.add_argument("export")
    p.add_argument("images")
    p.add_argument("out")
    p.add_argument("--val-split", type=float, default=0.2)
    p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("labels", help="an export to one label file a task")
    p.add_argument("export")
    p.add_argument("out")
    p = sub.add_parser("sample", help="frames of videos, every so many")
    p.add_argument("videos")
    p.add_argument("out")
    p.add_argument("--step", type=int, default=12)
    p.add_argument("--start", type=float)
    p.add_argument("--end", type=float)
    p = sub.add_parser("split", help="images with labels to train, val and test")
    p.add_argument("images")
    p.add_argument("labels")
    p.add_argument("out")
    p.add_argument("--train", type=float, default=0.7)
    p.add_argument("--val", type=float, default=0.15)
    p.add_argument("--seed", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = local_session()
    if a.command == "convert":
        made = dataset.convert_dataset(spark, a.export, a.images, a.out, a.val_split, a.seed)
        print(dataset.write_dataset(made, a.out), {r["status"]: r["n"] for r in made.status.collect()})
    elif a.command == "labels":
        dataset.must_exist(spark, a.export)
        sinks.write_texts(dataset.convert_labels(spark, a.export), a.out)
    elif a.command == "sample":
        dataset.must_exist(spark, a.videos)
        windows = sampling.windows(video.videos(video.probe(listing.list_videos(spark, a.videos))), a.start, a.end, a.step)
        video.write_frames(windows, a.out, a.step).show(truncate=False)
    else:
        dataset.must_exist(spark, a.images, a.labels)
        items = match.with_sidecar(listing.list_images(spark, a.images), listing.list_labels(spark, a.labels))
        cut = splits.three_way(items, "name", a.train, a.val, a.seed)
        sinks.make_layout(a.out, ("train", "val", "test"))
        sinks.copy_files(sinks.split_manifest(cut, a.out))


if __name__ == "__main__":
    main()
