"""File sources and sinks, and whole runs, on small folders."""

import json
import os

import pytest

from boxloom import __main__ as cli
from boxloom.functions import timecode
from boxloom.operators import sampling
from boxloom.plans import dataset
from boxloom.sources import exports, listing, sinks, video

BOX = {"type": "rectanglelabels", "value": {"x": 10, "y": 20, "width": 30, "height": 40, "rectanglelabels": ["Red Alliance Robot"]}}


def task(image, *boxes, **more):
    return {"data": {"image": image}, "annotations": [{"result": list(boxes)} | more]}


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith("."))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "images" / "deep").mkdir(parents=True)
    for i in range(5):
        (tmp_path / "images" / f"a{i}.jpg").write_bytes(b"jpg%d" % i)
    (tmp_path / "images" / "deep" / "x-b.jpg").write_bytes(b"deep")
    tasks = [task(f"/data/upload/1/u-a{i}.jpg", BOX) for i in range(5)]
    tasks += [task("a0.jpg", BOX, BOX), task("b.jpg", BOX), task("gone.jpg", BOX), task("a1.jpg"), task("a2.jpg", BOX, was_cancelled=True)]
    (tmp_path / "export.json").write_text(json.dumps(tasks))
    (tmp_path / "min.json").write_text(json.dumps([{"image": "a3.jpg", "label": [BOX["value"]]}]))
    return tmp_path


def test_convert_writes_the_dataset(spark, folder):
    out = f"{folder}/out"
    cli.main(["convert", f"{folder}/export.json", f"{folder}/images", out, "--val-split", "0.3"])
    files = tree(out)
    images = [f for f in files if f.startswith("images/")]
    assert len({os.path.basename(f) for f in images}) == 6 and "data.yaml" in files
    assert [f.replace("images/", "labels/").replace(".jpg", ".txt") for f in images] == [f for f in files if f.startswith("labels/")]
    line = "0 0.250000 0.400000 0.300000 0.400000\n"
    for f in images:
        with open(f"{out}/{f.replace('images/', 'labels/').replace('.jpg', '.txt')}") as label:
            assert label.read() in (line, 2 * line)
    made = dataset.convert_dataset(spark, f"{folder}/export.json", f"{folder}/images", out)
    assert {r["status"]: r["n"] for r in made.status.collect()} == {"ok": 7, "skipped_missing": 1, "skipped_empty": 2}
    assert made.manifest.count() == made.manifest.select("dst").distinct().count()
    with open(f"{out}/data.yaml") as f:
        assert f"path: {out}\ntrain: images/train\nval: images/val" in f.read()


def test_convert_checks_its_input(spark, folder):
    with pytest.raises(FileNotFoundError):
        dataset.convert_dataset(spark, f"{folder}/none.json", f"{folder}/images", "o")
    with pytest.raises(ValueError):
        dataset.convert_dataset(spark, f"{folder}/export.json", f"{folder}/images", "o", 1.0)
    (folder / "empty.json").write_text("[]")
    with pytest.raises(ValueError):
        dataset.write_dataset(dataset.convert_dataset(spark, f"{folder}/empty.json", f"{folder}/images", f"{folder}/o"), f"{folder}/o")


def test_exports_on_files(spark, folder):
    rows = exports.read_export(spark, f"{folder}/*.json").collect()
    assert len(rows) == 11 and sum(r["image_ref"] == "a3.jpg" and len(r["boxes"]) == 1 for r in rows) == 1
    (folder / "cut.json").write_text('[{"data": ')
    with pytest.raises(Exception, match="not a JSON array"):
        exports.read_export(spark, f"{folder}/cut.json").collect()
    (folder / "lines.txt").write_text("\n".join(json.dumps(t) for t in (task("a.jpg", BOX), {"image": "b.jpg", "label": []})))
    assert {r["image_ref"] for r in exports.read_export(spark, f"{folder}/lines.txt", lines=True).collect()} == {"a.jpg", "b.jpg"}


def test_labels_and_split_commands(spark, folder):
    cli.main(["labels", f"{folder}/export.json", f"{folder}/labels"])
    assert tree(f"{folder}/labels") == sorted([*(f"{s}.txt" for s in ("a0", "a1", "a2", "b", "gone")), *(f"u-a{i}.txt" for i in range(5))])
    assert (folder / "labels" / "a1.txt").read_text() == ""
    cli.main(["split", f"{folder}/images", f"{folder}/labels", f"{folder}/parts", "--train", "0.6", "--val", "0.2"])
    images = [f for f in tree(f"{folder}/parts") if f.endswith(".jpg")]
    assert [sum(f.startswith(s) for f in images) for s in ("train/images", "val/images", "test/images")] == [3, 1, 1]
    labels = [os.path.basename(f) for f in tree(f"{folder}/parts") if f.endswith(".txt")]
    assert sorted(labels) == ["a0.txt", "a1.txt", "a2.txt"]


def test_listings(spark, tmp_path):
    for i, n in enumerate(("b.MP4", "a.webm", "c.m4v", "d.txt")):
        (tmp_path / n).write_bytes(b"x")
        os.utime(tmp_path / n, (1000 + i, 1000 + i))
    found = listing.list_videos(spark, str(tmp_path))
    assert [r["name"] for r in found.collect()] == ["a.webm", "b.MP4", "c.m4v"]
    assert listing.newest(found).collect()[0]["path"].endswith("c.m4v")
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        listing.list_videos(spark, str(tmp_path / "none"))
    assert [r["name"] for r in listing.list_images(spark, str(tmp_path)).collect()] == []


def test_layouts_and_config(tmp_path):
    made = sinks.make_layout(str(tmp_path), ("train", "val"), "kind_first")
    assert [os.path.relpath(d, tmp_path) for d in made] == ["images/train", "labels/train", "images/val", "labels/val"]
    text = sinks.dataset_config("/d", ("one", "two"), test=True, count=True)
    assert text == "path: /d\ntrain: images/train\nval: images/val\ntest: images/test\nnc: 2\n\nnames:\n  0: one\n  1: two\n"


def test_fetching():
    whole = video.fetch_command("http://u", "/d/")
    assert whole[whole.index("-o") + 1] == "/d/%(id)s.%(ext)s" and whole[-1] == "http://u" and "--download-sections" not in whole
    part = video.fetch_command("http://u", "/d", 61.5, 3600)
    assert part[part.index("--download-sections") + 1] == "*0:01:01.500-1:00:00.000"
    assert video.fetched_path("x\n\n/d/a b.mp4\n \n") == "/d/a b.mp4" and video.fetched_path(" \n") is None


def test_clock_text_equals_the_column(spark):
    values = [0.0, 59.9996, 60.0, 61.5, 3599.25, 7325.125, 100000.0]
    rows = spark.createDataFrame([(v,) for v in values], "s double").select(timecode.format_time(timecode.F.col("s")).alias("t")).collect()
    assert [r["t"] for r in rows] == [timecode.clock_text(v) for v in values]


def test_frames_are_written_and_counted(spark, tmp_path):
    def decode(path, wanted):
        for i in wanted:
            yield i, None if i == 24 else f"{path} {i}".encode()

    table = spark.createDataFrame([("/v/one.mp4", 60, 30.0), ("/v/two.mp4", 0, 0.0)], "path string, total_frames int, fps double")
    got = video.write_frames(sampling.windows(video.videos(table)), str(tmp_path), 12, decode).collect()
    assert {r["path"]: (r["expected"], r["saved"]) for r in got} == {"/v/one.mp4": (5, 4), "/v/two.mp4": (0, 0)}
    assert tree(str(tmp_path)) == [f"one_f{i:07d}.jpg" for i in (0, 12, 36, 48)]
