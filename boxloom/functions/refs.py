"""Image references: names, stems, candidates, bucket paths, remote URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a page of the supported video site.
REMOTE_MARKERS = ("youtube.com/", "youtu.be/", "www.youtube.com/")

# Suffixes of video files.
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".m4v", ".webm")


def basename(path: Column) -> Column:
    """What follows the last slash (empty after a trailing slash)."""
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """Name without its last extension; leading dots never start one."""
    return F.regexp_extract(name, r"^([.]*[^.].*?)([.][^.]*)?$", 1)


def stem_or_name(name: Column) -> Column:
    s = stem(name)
    return F.when(s == "", name).otherwise(s)


def percent_decode(text: Column) -> Column:
    """Percent escapes decoded; ``+`` stays; malformed text is left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def url_path(ref: Column) -> Column:
    """The path part where the reference holds ``://``, else the reference.

    For http(s) the ``;params`` of the last segment go as well.
    """
    path = F.regexp_extract(ref, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    web = F.regexp_replace(path, r";[^/]*$", "")
    return F.when(~F.contains(ref, F.lit("://")), ref).when(F.lower(ref).rlike("^https?:"), web).otherwise(path)


def image_name(ref: Column) -> Column:
    """File name an annotation reference stands for."""
    return basename(F.rtrim(percent_decode(url_path(ref)), F.lit("/")))


def candidate_names(name: Column) -> Column:
    """The name, then what follows its first hyphen, if there is one."""
    rest = F.get(F.split(name, "-", 2), F.lit(1))
    return F.when(F.contains(name, F.lit("-")), F.array(name, rest)).otherwise(F.array(name))


def bucket_and_blob(ref: Column) -> tuple[Column, Column]:
    """``gs://bucket/blob`` -> both parts; blob is null when there is no slash."""
    parts = F.split(F.replace(ref, F.lit("gs://"), F.lit("")), "/", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def is_remote_video(ref: Column) -> Column:
    low = F.lower(ref)
    marked = F.lit(False)
    for m in REMOTE_MARKERS:
        marked = marked | F.contains(low, F.lit(m))
    return F.coalesce((F.startswith(low, F.lit("http://")) | F.startswith(low, F.lit("https://"))) & marked, F.lit(False))


def is_video_file(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)).isin(*VIDEO_SUFFIXES)


def first_string_value(raw_json: Column) -> Column:
    """First value of a JSON object, in key order, that is a string; else ''."""
    keys = F.json_object_keys(raw_json)
    kinds = F.from_json(raw_json, "map<string,variant>")
    named = F.filter(keys, lambda k: F.schema_of_variant(F.try_element_at(kinds, k)) == "STRING")
    value = F.try_variant_get(F.try_element_at(kinds, F.get(named, F.lit(0))), "$", "string")
    return F.coalesce(value, F.lit(""))
