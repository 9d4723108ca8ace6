"""Each pipeline stage on clashing names, nulls, repeated rows and empty tables."""

import pytest

import corpus_pipeline

NAMES = "_one long, _key string, _text string, gone_id long, c0 long, cid string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + NAMES
WORDS = [" ".join(f"w{i}x{k}" for k in range(70)) for i in range(9)]
LINE = "one and the same line in at least five of the documents"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, WORDS[3]), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, folder, k):
    extra = (7, "k", "t", 3, 4, "c")
    texts = [*(f"{LINE}\n{w}" for w in WORDS[:6]), f"{LINE}\n{WORDS[0]} more", "short", "", None, WORDS[8]]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), *extra) for i, t in enumerate(texts)]
    rows += [(None, WORDS[7], None, None, None, *extra), rows[1]]
    docs = spark.createDataFrame(rows, SCHEMA)
    name, stage = corpus_pipeline.STAGES[k]
    out, none = stage(spark, docs, folder), stage(spark, docs.where("false"), folder)
    assert none.columns == out.columns and none.count() == 0
    got = out.collect()
    ids = sorted((r["doc_id"] for r in got), key=lambda x: -1 if x is None else x)
    if name == "packing":
        assert set(ids) == {r[0] for r in rows}
        return
    assert out.columns == docs.columns and all(tuple(r)[5:] == extra for r in got)
    every = [None, 0, 1, 1, *range(2, 11)]
    gone = {"quality rules": {7, 8, 9}, "line dedup": set(), "n-gram jaccard join": {6}, "benchmark decontamination": {3}}[name]
    assert ids == [i for i in every if i not in gone]
    if name == "line dedup":
        text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got}
        assert text[9] == (None, None) and text[6] == (texts[6], len(texts[6])) and text[0] == (WORDS[0], len(WORDS[0])) and text[None][0] == WORDS[7]
