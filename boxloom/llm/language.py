"""Language of a text by word-first backoff.

Training: per-language log frequencies of words, and of character n-grams of
the words (with their ends), on a bounded sample: at most SAMPLE_DOCS labelled
documents a language, the first by a hash of their id, whole texts and all their
words and n-grams.  That bounds the model by the number of languages, so it can
be broadcast.

Prediction, over whole texts: words are runs of letters (Unicode category L).  A known word scores by its log frequency in each
language; an unknown one by its n-grams, the longest order first, going to
shorter ones until one is known.  The language with the highest mean score
wins; its share in a softmax over the summed scores is the score.

Null texts, and texts without a letter, are 'und' with score 0, as is
everything when there is nothing to learn from.  Ties go to the first language
in order.  Rows repeat as they are; only doc_id, text and (for training) lang
are read.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import CACHES, frugal, slices, text_bytes
from boxloom.llm.units import UnitTable

FOLDS = 5
SAMPLE_DOCS = 800
TEAMS = 256
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Numbers that the standard library's \w takes in, but for decimal digits.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
_WORDS = re.compile(rf"[^\W\d_{NUMBERS}]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def counts(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, size, gram, n): size 0 for words, else the n-gram's order."""
    pool = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    ids = pool.select("doc_id", "lang", (F.spark_partition_id() % TEAMS).alias("_team"))
    for group in (["lang", "_team"], ["lang"]):  # the first of each team, then of those: no task gets a row of every partition
        first = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample).drop("_n")
    ids = ids.select("doc_id").distinct()
    chosen = pool.join(F.broadcast(ids), "doc_id", "left_semi")  # at most `sample` ids a language
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    marked = F.concat(F.lit("<"), F.col("gram"), F.lit(">"))
    parts = None
    for k in ORDERS:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marked) - (k - 1), F.lit(1))), _part(marked, k))
        one = words.select("lang", "n", F.lit(k).alias("size"), F.explode(grams).alias("gram"))
        parts = one if parts is None else parts.unionByName(one)
    grams = parts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return grams.unionByName(words.withColumn("size", F.lit(0)))


def _part(text: Column, k: int):
    return lambda i: F.substring(text, i, F.lit(k))


class Model:
    def __init__(self, rows: Iterable) -> None:
        rows = list(rows)
        self.langs = sorted({r["lang"] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        totals: dict[tuple[int, int], int] = {}
        raw: dict[int, dict[str, dict[int, int]]] = {}
        for r in rows:
            lang = at[r["lang"]]
            totals[r["size"], lang] = totals.get((r["size"], lang), 0) + r["n"]
            raw.setdefault(r["size"], {}).setdefault(r["gram"], {})[lang] = r["n"]
        self.tables = {}
        for size, grams in raw.items():
            none = [math.log(0.5 / (totals.get((size, i), 0) + len(grams))) for i in range(len(self.langs))]
            self.tables[size] = {g: tuple(math.log((by[i] + 0.5) / (totals[size, i] + len(grams))) if i in by else none[i] for i in range(len(self.langs))) for g, by in grams.items()}
        self.flat = tuple(0.0 for _ in self.langs)
        self.backoff = [(k, {g: v for g, v in self.tables.get(k, {}).items() if len(g) == k}) for k in ORDERS]

    def word(self, word: str) -> list[float] | tuple[float, ...]:
        """Log scores by language, relative to the best one."""
        got = self.tables.get(0, {}).get(word)
        if got is None:
            marked, hits = f"<{word}>", []
            for i in range(len(marked)):
                for k, table in self.backoff:
                    hit = table.get(marked[i : i + k])  # the word's end is shorter than k: no such n-gram
                    if hit is not None:
                        hits.append(hit)
                        break
            if not hits:
                return self.flat
            got = [x / len(hits) for x in map(sum, zip(*hits, strict=True))]
        top = max(got)
        return [x - top for x in got]


class Scores(UnitTable):
    """Of each unit its words' summed scores by language, and their number."""

    def __init__(self, model: Model) -> None:
        self.model = model
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.rows = np.zeros((1024, len(self.model.langs) + 1))

    def learn(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> None:
        room = self.n_units + len(start)
        if room > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((room, self.rows.shape[1]))])
        data, score, none = low.tobytes(), self.model.word, [*self.model.flat, 0]
        new = []
        for i, n in zip(start.tolist(), size.tolist(), strict=True):
            words = _WORDS.findall(data[i : i + n].decode().lower())
            if len(words) == 1:
                new.append([*score(words[0]), 1])
            else:
                new.append([*map(sum, zip(*map(score, words), strict=True)), len(words)] if words else none)
        self.rows[self.n_units : room] = new


    def predict(self, texts: pa.Array) -> Iterator[tuple[str, float]]:
        """(language, score) of each text."""
        langs = self.model.langs
        raw, at = text_bytes(texts)
        for lo, hi in slices(at):
            number, first = self.numbers(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            # the zero row ends the last text's; one more of each text would change no sum
            rows = np.concatenate([self.rows[number], np.zeros((1, len(langs) + 1))])
            sums = np.add.reduceat(rows, first[:-1], axis=0)
            for total, empty in zip(sums, (first[1:] == first[:-1]).tolist(), strict=True):
                if empty or not total[-1] or not langs:
                    yield UNKNOWN, 0.0
                    continue
                best = int(total[:-1].argmax())
                yield langs[best], float(1 / np.exp(np.clip(total[:-1] - total[best], -700, 0)).sum())


#: The worker's model, by the name of its run.
MODELS: dict[str, Scores] = {}
CACHES.append(MODELS.clear)


def identify(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = counts(docs, sample).collect()  # what `sample` texts a language hold
    model = docs.sparkSession.sparkContext.broadcast([(r["lang"], r["size"], r["gram"], r["n"]) for r in found])
    name = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in MODELS:  # once a worker
            MODELS.clear()
            MODELS[name] = Scores(Model({"lang": a, "size": b, "gram": c, "n": d} for a, b, c, d in model.value))
        predict = MODELS[name].predict
        for b in batches:
            out = list(predict(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return slim.mapInArrow(frugal(run, keep_caches=True), "doc_id long, held_out boolean, lang_pred string, score double")
