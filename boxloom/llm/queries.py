"""opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxloom.llm import decontam, quality
from boxloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.decontam import contamination_digest

    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


ORACLES["op3_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
ORACLES["op1_quality_rules"] = quality.oracle_sql()
ORACLES["op4_decontamination"] = decontam.ORACLE_SQL
