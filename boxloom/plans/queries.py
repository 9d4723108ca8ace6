"""Registered queries and their SQL.

Two kinds: queries over the star-schema tables under a fixed mapping onto the
domain, and queries over literal cases whose SQL lists hand-derived results.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions import refs as R
from boxloom.functions import timecode as T
from boxloom.operators import convert, match, sampling, splits
from boxloom.sources import exports, listing, sinks, video

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- star-schema mapping ----------------------------------------------------

RED, BLUE = G.CLASS_NAMES
KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def lineitem_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as exploded boxes: task l_orderkey, label from l_returnflag."""
    li = table(spark, sf_dir, "lineitem").select(*KEYS, "l_returnflag", "l_discount", "l_tax", "l_quantity")
    label = F.when(F.col("l_returnflag") == "R", RED).when(F.col("l_returnflag") == "A", BLUE).otherwise("unknown")
    nums = {"x": F.col("l_discount") * 1000.0, "y": F.col("l_tax") * 1000.0, "width": F.col("l_quantity"), "height": F.col("l_quantity") / 2.0}
    box = F.struct(
        F.when(F.col("l_linenumber") == 7, "choices").otherwise("rectanglelabels").alias("kind"),
        *[v.alias(k) for k, v in nums.items()],
        *[F.lit("n").alias(f"{k}_raw") for k in nums],
        F.array(label).alias("labels"),
    )
    return li.select(*KEYS, box.alias("box"))


BOX_SQL = """
boxes AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END AS class_id,
    l_discount * 1000.0::DOUBLE / 100.0::DOUBLE + (l_quantity / 100.0::DOUBLE) / 2.0::DOUBLE AS cx0,
    l_tax * 1000.0::DOUBLE / 100.0::DOUBLE + (l_quantity / 2.0::DOUBLE / 100.0::DOUBLE) / 2.0::DOUBLE AS cy0,
    l_quantity / 100.0::DOUBLE AS w0, l_quantity / 2.0::DOUBLE / 100.0::DOUBLE AS h0
  FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag IN ('R', 'A')),
clamped AS (
  SELECT * EXCLUDE (cx0, cy0, w0, h0), least(greatest(cx0, 0), 1)::DOUBLE AS cx, least(greatest(cy0, 0), 1)::DOUBLE AS cy,
    least(greatest(w0, 0), 1)::DOUBLE AS w, least(greatest(h0, 0), 1)::DOUBLE AS h FROM boxes),
lines AS (
  SELECT *, class_id || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy) || ' ' || printf('%.6f', w) || ' ' || printf('%.6f', h) AS line FROM clamped)
"""


@query(f"WITH {BOX_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(class_id AS INTEGER) AS class_id, cx, cy, w, h, line FROM lines")
def box_lines(spark, sf_dir):
    out = convert.box_lines(lineitem_boxes(spark, sf_dir)).where("status = 'ok'")
    return out.select(*KEYS, "class_id", "cx", "cy", "w", "h", "line")


@query("""SELECT CASE WHEN l_linenumber = 7 THEN 'not_rectangle' WHEN l_returnflag NOT IN ('R', 'A') THEN 'unknown_label' ELSE 'ok' END AS status,
  count(*) AS n FROM lineitem GROUP BY 1""")
def run_counters(spark, sf_dir):
    return convert.run_counters(convert.box_lines(lineitem_boxes(spark, sf_dir)))


@query(f"""WITH {BOX_SQL} SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_lines,
  string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, line) || chr(10) AS text
  FROM lines JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = l_orderkey GROUP BY 1""")
def task_label_text(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = convert.box_lines(lineitem_boxes(spark, sf_dir)).join(tasks, "l_orderkey", "left_semi")
    return convert.collect_lines(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


def _split_sql(seed: str, parts: str) -> str:
    return f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
  SELECT doc_id, {parts} AS split FROM r"""


@query(_split_sql("42", "CASE WHEN r < floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END"))
def split_two_way(spark, sf_dir):
    return splits.val_first(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(_split_sql("0", "CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END"))
def split_train_first(spark, sf_dir):
    return splits.train_first(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(_split_sql("0", "CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train' WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END"))
def split_three_way(spark, sf_dir):
    return splits.three_way(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""WITH s AS (SELECT n, unnest(['train', 'val', 'test']) AS split FROM (VALUES (3), (6), (100)) t(n))
  SELECT n, split, CASE split WHEN 'train' THEN floor(n * 0.7::DOUBLE) WHEN 'val' THEN floor(n * 0.15::DOUBLE)
    ELSE n - floor(n * 0.7::DOUBLE) - floor(n * 0.15::DOUBLE) END::BIGINT AS rows FROM s
  WHERE CASE split WHEN 'train' THEN floor(n * 0.7::DOUBLE) WHEN 'val' THEN floor(n * 0.15::DOUBLE) ELSE 1 END > 0""")
def split_sizes(spark, sf_dir):
    out = None
    for n in (3, 6, 100):
        part = splits.three_way(spark.range(n), "id").groupBy("split").agg(F.count("*").alias("rows")).withColumn("n", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.select("n", "split", "rows")


def order_videos(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("video_"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("path"),
        F.floor(F.col("o_totalprice") / 100.0).cast("int").alias("total_frames"),
        F.lit(29.97).alias("fps"),
    )


@query("""WITH v AS (SELECT 'video_' || o_orderkey AS stem, CAST(floor(o_totalprice / 100.0::DOUBLE) AS BIGINT) AS total FROM orders),
  w AS (SELECT stem, CAST(round_even(5.01::DOUBLE * 29.97::DOUBLE, 0) AS BIGINT) AS f, least(total, CAST(round_even(20.5::DOUBLE * 29.97::DOUBLE, 0) AS BIGINT)) AS l FROM v),
  p AS (SELECT stem, unnest(range(f, l, 12)) AS frame_idx FROM w WHERE l > f)
  SELECT stem, frame_idx, stem || '_f' || lpad(CAST(frame_idx AS VARCHAR), 7, '0') || '.jpg' AS file_name FROM p""")
def frame_plan(spark, sf_dir):
    return sampling.frame_plan(sampling.windows(video.videos(order_videos(spark, sf_dir)), 5.01, 20.5))


@query(r"""SELECT page_id, regexp_extract(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', ''), '[^/]*$') AS name FROM pages""")
def resolve_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.image_name(F.col("url")).alias("name"))


@query("SELECT max_by(props, struct_pack(ts := ts, id := event_id)) AS path FROM events")
def newest_by_time(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max_by("props", F.struct("ts", "event_id")).alias("path"))


# --- literal cases ----------------------------------------------------------


def literal(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({names})"


def box(x, y, w, h, label=RED, **more):
    v = {k: n for k, n in (("x", x), ("y", y), ("width", w), ("height", h)) if n is not None}
    return v | ({"rectanglelabels": [label]} if label is not None else {"rectanglelabels": []}) | more


def result(*a, kind="rectanglelabels", **k):
    return {"type": kind, "value": box(*a, **k)}


FULL = [
    {"data": {"z": 1, "image": "u", "a": "v"}, "annotations": [{"was_cancelled": True, "result": [result(1, 1, 2, 2)]}, {"result": [result(10, 20, 30, 40)]}]},
    {"data": {"image": "gs://b/d/two.jpg"}, "annotations": []},
    {"data": {"image": "three.jpg"}, "annotations": [{"was_cancelled": 1, "result": [result(50, 50, 10, 10)]}]},
    {"data": {"image": "four.jpg"}, "annotations": [{"result": [result(90, 0, 50, 10, BLUE), result(1, 1, 1, 1, "Referee"), result(1, 1, 1, 1, kind="choices"), result(1, 1, 1, 1, None)]}, {"result": [result(None, "10", 20, 20)]}]},
    {"data": "none", "annotations": [{"result": [result(0, 0, 100, 100)]}]},
]


def export_df(spark, tasks) -> DataFrame:
    return exports.tasks_of(literal(spark, [("f.json", json.dumps(tasks))], "file string, value string"))


def texts_of(tasks, clamp, zero, keep) -> DataFrame:
    return convert.label_texts(tasks, clamp, zero, keep).select("ordinal", "image_ref", "n_lines", "text")


@query(values(
    "ordinal, image_ref, n_lines, text",
    "0, 'u', 1, '0 0.020000 0.020000 0.020000 0.020000' || chr(10)", "1, 'gs://b/d/two.jpg', 0, ''", "2, 'three.jpg', 1, '0 0.550000 0.550000 0.100000 0.100000' || chr(10)",
    "3, 'four.jpg', 1, '1 1.150000 0.050000 0.500000 0.100000' || chr(10)", "4, '', 1, '0 0.500000 0.500000 1.000000 1.000000' || chr(10)"))
def export_first(spark, sf_dir):
    return texts_of(exports.full_tasks(export_df(spark, FULL), "first", "image"), False, False, True)


@query(values(
    "ordinal, image_ref, n_lines, text",
    "0, 'u', 1, '0 0.250000 0.400000 0.300000 0.400000' || chr(10)",
    "3, 'four.jpg', 2, '1 1.000000 0.050000 0.500000 0.100000' || chr(10) || '0 0.100000 0.200000 0.200000 0.200000' || chr(10)", "4, '', 1, '0 0.500000 0.500000 1.000000 1.000000' || chr(10)"))
def export_all(spark, sf_dir):
    return texts_of(exports.full_tasks(export_df(spark, FULL), "all"), True, True, False)


MIN = [{"image": "", "img": "m1.jpg", "label": [box(10, 20, 30, 40)]}, {"image": "m2.jpg", "label": None}, {"label": [box(1, 1, 1, 1, "x")]}]


@query(values("ordinal, image_ref, n_lines, text", "0, 'm1.jpg', 1, '0 0.250000 0.400000 0.300000 0.400000' || chr(10)", "1, 'm2.jpg', 0, ''", "2, '', 0, ''"))
def export_min(spark, sf_dir):
    return texts_of(exports.min_tasks(export_df(spark, MIN)), True, False, True)


@query(values("file, is_min", "'full', false", "'min', true", "'nullann', false", "'nulllabel', true"))
def export_sniff(spark, sf_dir):
    files = {"full": FULL, "min": MIN, "nullann": [{"label": [], "annotations": None}], "nulllabel": [{"label": None}]}
    return exports.is_min_format(exports.tasks_of(literal(spark, [(k, json.dumps(v)) for k, v in files.items()], "file string, value string")))


@query(values("k, line", "'r1', '0 0.250000 0.400000 0.300000 0.400000'", "'r2', '1 1.000000 0.050000 0.500000 0.100000'", "'r7', '0 0.123456 0.123456 0.000000 0.000000'", "'r15', '0 0.100000 0.000000 0.000000 0.000000'", "'none', NULL"))
def box_lines_edge(spark, sf_dir):
    cases = {"r1": box(10, 20, 30, 40), "r2": box(90, 0, 50, 10, BLUE), "r7": box(12.34565, 12.34565, 0, 0), "r15": box("10", 0, 0, 0), "none": box(1, 1, 1, 1, None)}
    tasks = exports.min_tasks(exports.tasks_of(literal(spark, [(k, json.dumps([{"image": k, "label": [b]}])) for k, b in cases.items()], "file string, value string")))
    return convert.box_lines(convert.explode_boxes(tasks)).select(F.col("file").alias("k"), "line")


@query(values("stem, text, n_writes", "'a', 'second', 2", "'b', '', 1"))
def last_write_wins(spark, sf_dir):
    return convert.last_write_wins(literal(spark, [("a", "first", 0), ("b", "", 1), ("a", "second", 2)], "stem string, text string, ordinal int"))


TIMES = ["90", "1:30", "1:30:45", " ", "1:2:3:4", "-5", "1:-5", "1e2", "1d", "nan", "1_0", ".5", None, "a:b", "0:0:1.5"]


@query(values("i, seconds, error", "0, 90::DOUBLE, false", "1, 90, false", "2, 5445, false", "3, NULL, false", "4, NULL, true", "5, NULL, true", "6, 55, false", "7, 100, false", "8, NULL, true", "9, NULL, true", "10, NULL, true", "11, 0.5, false", "12, NULL, false", "13, NULL, true", "14, 1.5, false"))
def parse_time(spark, sf_dir):
    t = literal(spark, list(enumerate(TIMES)), "i int, t string")
    return t.select("i", T.parse_time(F.col("t")).alias("seconds"), T.time_error(F.col("t")).alias("error"))


@query(values("seconds, shown, section", "0::DOUBLE, '0:00:00.000', '*0:00:00.000-0:00:01.000'", "59.9996, '0:00:60.000', '*0:00:60.000-0:01:01.000'", "5445.25, '1:30:45.250', '*1:30:45.250-1:30:46.250'", "36000.5, '10:00:00.500', '*10:00:00.500-10:00:01.500'"))
def format_time(spark, sf_dir):
    t = literal(spark, [(0.0,), (59.9996,), (5445.25,), (36000.5,)], "seconds double")
    s = F.col("seconds")
    return t.select("seconds", T.format_time(s).alias("shown"), T.section(s, s + 1.0).alias("section"))


VIDEOS = [("d/a.mp4", 100, 10.0, False), ("d/b.mov", 100, 0.0, False), ("d/c.mkv", 100, 10.0, True), ("d/e.avi", 5, 10.0, False)]


@query(values("stem, first, last, expected", "'a', 10::BIGINT, 50::BIGINT, 4::BIGINT", "'b', 30, 100, 6", "'c', 0, 100, 9", "'e', 10, 5, 0"))
def frame_window(spark, sf_dir):
    v = literal(spark, VIDEOS, "path string, total_frames int, fps double, already_trimmed boolean")
    return sampling.windows(video.videos(v), 1.0, 5.0).select("stem", "first", "last", "expected")


@query(values("stem, frame_idx, file_name", *(f"'a', {i}::BIGINT, 'a_f{i:07d}.jpg'" for i in (10, 22, 34, 46))))
def frame_plan_edge(spark, sf_dir):
    v = literal(spark, [VIDEOS[0], VIDEOS[3]], "path string, total_frames int, fps double, already_trimmed boolean")
    return sampling.frame_plan(sampling.windows(video.videos(v), 1.0, 5.0))


@query(values("sec, frame", "0.25::DOUBLE, 2::BIGINT", "0.35, 4", "0.5, 5"))
def seconds_to_frame(spark, sf_dir):
    t = literal(spark, [(0.25,), (0.35,), (0.5,)], "sec double")
    return t.select("sec", T.frame_at(F.col("sec"), F.lit(10.0)).alias("frame"))


REFS = ["a+b%20c.jpg", "a%zz.jpg", "/data/local-files/?d=f%2Fx.jpg", "http://h/data/local-files/?d=f/x.jpg", "gs://b/p/q.jpg;v=1", "http://h/p/q.jpg;v=1", "http://h/a b.jpg", "", "/d/u/1/a1-f.jpg"]


@query(values("i, name", "0, 'a+b c.jpg'", "1, 'a%zz.jpg'", "2, 'x.jpg'", "3, 'local-files'", "4, 'q.jpg;v=1'", "5, 'q.jpg'", "6, 'a b.jpg'", "7, ''", "8, 'a1-f.jpg'"))
def resolve_names_edge(spark, sf_dir):
    return literal(spark, list(enumerate(REFS)), "i int, r string").select("i", R.image_name(F.col("r")).alias("name"))


@query(values("name, candidates", "'a1b2c3d4-frame.jpg', 'a1b2c3d4-frame.jpg|frame.jpg'", "'match-1_f01.jpg', 'match-1_f01.jpg|1_f01.jpg'", "'a-b-c.jpg', 'a-b-c.jpg|b-c.jpg'", "'plain.jpg', 'plain.jpg'"))
def candidate_names(spark, sf_dir):
    t = literal(spark, [("a1b2c3d4-frame.jpg",), ("match-1_f01.jpg",), ("a-b-c.jpg",), ("plain.jpg",)], "name string")
    return t.select("name", F.array_join(R.candidate_names(F.col("name")), "|").alias("candidates"))


@query(values("ref, bucket, blob, dst, ok", "'gs://b/p/q.jpg', 'b', 'p/q.jpg', 'images/q.jpg', true", "'b/q', 'b', 'q', 'images/q', true", "'gs://only', 'only', NULL, NULL, false"))
def bucket_blob(spark, sf_dir):
    t = literal(spark, [("gs://b/p/q.jpg",), ("b/q",), ("gs://only",)], "image_ref string")
    return video.object_store_images(spark, t).withColumnRenamed("image_ref", "ref")


@query(values("name, stem", "'a.b.jpg', 'a.b'", "'.jpg', '.jpg'", "'..jpg', '..jpg'", "'x', 'x'", "'d/y.txt', 'y'"))
def stems(spark, sf_dir):
    t = literal(spark, [("a.b.jpg",), (".jpg",), ("..jpg",), ("x",), ("d/y.txt",)], "name string")
    return t.select("name", R.stem_or_name(R.basename(F.col("name"))).alias("stem"))


@query(values("i, remote", "0, true", "1, true", "2, false", "3, false", "4, true"))
def remote_url(spark, sf_dir):
    urls = ["https://youtu.be/x", "HTTP://WWW.YouTube.com/watch?v=1", "ftp://youtube.com/x", "clip.mp4", "http://h/?u=youtu.be/"]
    return literal(spark, list(enumerate(urls)), "i int, u string").select("i", R.is_remote_video(F.col("u")).alias("remote"))


@query(values("raw, value", """'{"z":1,"image":"u","a":"v"}', 'u'""", """'{"b":null,"a":{"x":"y"}}', ''""", "'[1]', ''"))
def first_string(spark, sf_dir):
    t = literal(spark, [('{"z":1,"image":"u","a":"v"}',), ('{"b":null,"a":{"x":"y"}}',), ("[1]",)], "raw string")
    return t.select("raw", F.coalesce(R.first_string_value(F.col("raw")), F.lit("")).alias("value"))


TASKS = [(1, "/u/1/h1-one.jpg", 1), (2, "two.jpg", 0), (3, "http://h/deep.jpg", 2), (4, "gone.jpg", 0), (5, "", 1)]
IMAGES = [("r/one.jpg", "one.jpg"), ("r/two.jpg", "two.jpg")]
TREE = [*IMAGES, ("r/s/z_deep.jpg", "z_deep.jpg"), ("r/s/deep.jpg", "deep.jpg")]


def _match(spark, tree=True):
    t = literal(spark, TASKS, "task_id int, image_ref string, n_lines int")
    files = lambda rows: literal(spark, rows, "path string, name string")
    return t, match.match_images(t, files(IMAGES), files(TREE) if tree else None)


@query(values("task_id, path, status", "1, 'r/one.jpg', 'ok'", "2, 'r/two.jpg', 'skipped_empty'", "3, NULL, 'skipped_missing'", "4, NULL, 'skipped_missing'", "5, NULL, 'skipped_missing'"))
def match_images(spark, sf_dir):
    return _match(spark, False)[1].select("task_id", "path", match.task_status().alias("status"))


@query(values("task_id, path", "1, 'r/one.jpg'", "2, 'r/two.jpg'", "3, 'r/s/deep.jpg'", "4, NULL", "5, NULL"))
def match_suffix(spark, sf_dir):
    return _match(spark)[1].select("task_id", "path")


@query(values("task_id", "4", "5"))
def missing_images(spark, sf_dir):
    return match.missing_images(*_match(spark)).select("task_id")


@query(values("stem, path, label_path", "'a', 'i/a.jpg', 'l/a.txt'", "'b', 'i/b.jpg', NULL"))
def sidecar(spark, sf_dir):
    images = literal(spark, [("i/a.jpg", "a"), ("i/b.jpg", "b")], "path string, stem string")
    labels = literal(spark, [("l/a.txt", "a"), ("l/c.txt", "c")], "path string, stem string")
    return match.with_sidecar(images, labels).select("stem", "path", "label_path")


@query(values("path", "'v/b.mp4'"))
def newest_file(spark, sf_dir):
    t = literal(spark, [("v/a.mp4", 1), ("v/b.mp4", 3), ("v/c.mp4", 2)], "path string, mtime int")
    return listing.newest(t)


@query(values("src, dst, split, kind", "'i/a.jpg', 'o/train/images/a.jpg', 'train', 'images'", "'l/a.txt', 'o/train/labels/a.txt', 'train', 'labels'", "'i/b.jpg', 'o/val/images/b.jpg', 'val', 'images'"))
def split_manifest(spark, sf_dir):
    items = literal(spark, [("i/a.jpg", "a.jpg", "a", "train", "l/a.txt"), ("i/b.jpg", "b.jpg", "b", "val", None)], "path string, name string, stem string, split string, label_path string")
    return sinks.split_manifest(items, "o")
