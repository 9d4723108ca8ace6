"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each text is measured (features), then judged by rules "feature > cutoff".  The
cutoffs are not chosen by hand: on the labelled documents of good quality (the
holdout; nothing is fitted on them) one fixed sequence of steps is walked in
every stratum, rule after rule, each along its grid from lenient to strict.  A
step's losses are the good documents that the rules as tightened so far reject
together, and the walk goes on while the exact binomial test rejects "more than
`risk` of the good documents would be lost": the p-value is
P(Binomial(n, risk) <= losses).  A fixed sequence needs no correction along its
steps, so neither along a grid nor over the rules; strata are corrected for
(Bonferroni): each test has level delta / strata.  So, with probability
1 - delta, no stratum loses more than `risk` of its good documents to the rules.

A stratum with so few labels that not even a loss of none could pass is walked
together with the other such strata, as one: the bound then holds for their
pool, not for each of them.  If the pool is too small as well, or a stratum has no
labelled good document, there is no cutoff and its rows stay.

Texts: null or without words fails the base rules (no words).  A null lang is a
stratum of its own.  A document counts as good if all its labels that aren't
null say so; labels without a document are ignored; repeated rows of one doc_id
count each.  Only doc_id, text and lang are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import SPACE, sized, without, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RISK = 0.02
DELTA = 0.05
STRATUM = "lang"

#: Rules in the order of the walk, and their grids, lenient first.  First come the
#: measures that ordinary prose doesn't have at all.
GRIDS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02],
    "word_length": [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0],
    "shout_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
}


def steps(grids: dict) -> list[tuple[str, float, dict[str, float]]]:
    """(rule, cutoff, all cutoffs at that step), in the order of the walk."""
    out, now = [], {}
    for rule, grid in grids.items():
        for cutoff in grid:
            now = now | {rule: cutoff}
            out.append((rule, float(cutoff), now))
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_words", F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+"), ""))


def _repeated_windows(words: str) -> list[tuple[str, Column]]:
    """Steps to n_repeat_words.  Window hashes are packed with their position
    into one long (the hash gives way only for the bits a position needs), so
    that a primitive sort brings equal windows together; the full hashes are
    compared then."""
    n = F.size(words)
    code = F.transform(words, lambda w: F.xxhash64(w))
    at = lambda a, i: F.get(a, i)
    tri = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(F.col("_code"), i), at(F.col("_code"), i + 1), at(F.col("_code"), i + 2)))).otherwise(F.array().cast("array<bigint>"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + F.lit(2))).cast("int")) - F.lit(1).cast("long")
    packed = F.sort_array(F.transform("_tri", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_mask"))).bitwiseOR(i.cast("long"))))

    def same(x: Column, j: Column) -> Column:
        y = at(F.col("_packed"), j)
        pos = lambda v: v.bitwiseAND(F.col("_mask")).cast("int")
        return F.coalesce(at(F.col("_tri"), pos(x)) == at(F.col("_tri"), pos(y)), F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_packed", lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1)), lambda x: x.bitwiseAND(F.col("_mask"))))
    gained = F.transform("_starts", lambda p, i: F.when(i == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), p - at(F.col("_starts"), i - 1))))
    total = F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x)
    return [("_code", code), ("_tri", tri), ("_mask", mask), ("_packed", packed), ("_starts", starts), ("n_repeat_words", total)]


def measure(docs: DataFrame) -> DataFrame:
    """docs + base measures, base_failed and the rules' features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = with_words(docs)
    for name, col in _repeated_windows("_words"):
        df = df.withColumn(name, col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_upper": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")),
        "_n_lines": F.size("_lines"),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    df = df.withColumns({
        "symbol_share": _ratio(F.col("n_symbols"), F.col("word_chars")),
        "repeat_share": _ratio(F.col("n_repeat_words"), F.col("n_words")),
        "dup_line_share": _ratio(F.col("n_dup_lines"), F.col("_n_lines")),
        "shout_share": _ratio(F.col("_upper"), F.col("word_chars")),
        "word_length": _ratio(F.col("word_chars"), F.col("n_words")),
    })
    return df.drop("_words", "_lines", "_code", "_tri", "_mask", "_packed", "_starts", "_upper", "_n_lines")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact, in logarithms; 1 where k >= n * p (such a
    count rejects nothing)."""
    odds, none = math.log(p / (1 - p)), math.log1p(-p)

    def step(acc: Column, j: Column) -> Column:
        term = F.when(j == 0, n * F.lit(none)).otherwise(acc["term"] + F.log((n - j + 1).cast("double") / j) + F.lit(odds))
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), F.when(j == 0, term).otherwise(high + F.log1p(F.exp(low - high))).alias("total"))

    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(k, F.floor(n * F.lit(p)))), start, step, lambda a: a["total"])
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(total))


def good_documents(labels: DataFrame) -> DataFrame:
    """(doc_id): those whose labels all say quality 1."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def select_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = STRATUM, grids: dict | None = None) -> DataFrame:
    """(stratum, one column a rule): the strictest cutoff proven safe, or null."""
    grids = grids or GRIDS
    walk = steps(grids)
    good = measured.where(~F.col("base_failed")).join(good_documents(labels), "doc_id", "left_semi")
    lost = [reduce(lambda a, b: a | b, [F.col(r) > c for r, c in now.items()]) for _, _, now in walk]
    losses = F.array(*[F.count_if(x) for x in lost])
    counts = written(good.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), losses.alias("losses")), "strata")
    level = delta / max(1, counts.count())
    counts = counts.withColumn("pooled", F.col("n") < math.log(level) / math.log1p(-risk))
    counts = counts.withColumn("member", F.when(~F.col("pooled"), F.col("stratum")))
    tests = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.get("losses", t).alias("k")) for t, (r, c, _) in enumerate(walk)])
    rows = counts.select("pooled", "member", "n", F.explode(tests).alias("s")).groupBy("pooled", "member", "s.t", "s.rule", "s.cutoff").agg(F.sum("n").alias("n"), F.sum("s.k").alias("k"))
    so_far = Window.partitionBy("pooled", "member").orderBy("t")
    passed = rows.withColumn("safe", F.min((binomial_cdf(F.col("k"), F.col("n"), risk) <= level).cast("int")).over(so_far) == 1)
    best = [F.min(F.when(F.col("safe") & (F.col("rule") == r), F.col("cutoff"))).alias(f"max_{r}") for r in grids]
    found = passed.groupBy(F.col("pooled").alias("_pooled"), F.col("member").alias("_member")).agg(*best)
    same = (counts["pooled"] == found["_pooled"]) & counts["member"].eqNullSafe(found["_member"])
    return counts.join(found, same).select("stratum", *[f"max_{r}" for r in grids])


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = STRATUM) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the rule that failed.

    The measures are taken once, for all documents, into a narrow table; labels
    meet that table, not the texts.
    """
    keep = ["doc_id", stratum, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *GRIDS]
    narrow = docs.select("doc_id", "text", stratum)
    measured = written(measure(narrow).select(*keep), "quality")
    cutoffs = written(select_cutoffs(measured, labels, risk, delta, stratum), "cutoffs")
    out = measured.join(sized(cutoffs), measured[stratum].eqNullSafe(cutoffs["stratum"]), "left")
    why = reduce(lambda c, r: c.when(F.col(r) > F.col(f"max_{r}"), r), GRIDS, F.when(F.col("base_failed"), "base"))
    out = out.withColumn("failed_rule", why).withColumn("kept", F.col("failed_rule").isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns.  The verdict meets them by
    doc_id; rows that share a doc_id stay if one of them passes."""
    verdict = judge(docs, labels).groupBy("doc_id").agg(F.bool_or("kept").alias("stays"))
    return without(docs, verdict.where("NOT stays"))


def oracle_sql(risk: float = RISK, delta: float = DELTA) -> str:
    walk = steps(GRIDS)
    lost = lambda now: " OR ".join(f"{r} > {c}::DOUBLE" for r, c in now.items())
    tests = ", ".join(f"{{'t': {t}, 'rule': '{r}', 'cutoff': {c}::DOUBLE, 'k': count_if({lost(now)})}}" for t, (r, c, now) in enumerate(walk))
    fail = " ".join(f"WHEN {r} > max_{r} THEN '{r}'" for r in GRIDS)
    best = ", ".join(f"min(cutoff) FILTER (rule = '{r}' AND walked) AS max_{r}" for r in GRIDS)
    ratio = lambda x, y: f"CASE WHEN {y} > 0 THEN {x}::DOUBLE / {y} ELSE 0 END"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c >= 2) GROUP BY 1),
m AS (SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper_chars, len(lines) AS n_lines
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  {ratio('n_symbols', 'word_chars')} AS symbol_share, {ratio('n_repeat_words', 'n_words')} AS repeat_share,
  {ratio('n_dup_lines', 'n_lines')} AS dup_line_share, {ratio('upper_chars', 'word_chars')} AS shout_share, {ratio('word_chars', 'n_words')} AS word_length FROM m),
good AS (SELECT f.* FROM f SEMI JOIN (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
s AS (SELECT lang, count(*) AS n, [{tests}] AS tests FROM good GROUP BY lang),
level AS (SELECT {delta}::DOUBLE / greatest(1, count(*)) AS level FROM s),
v AS (SELECT lang, n, tests, n < ln(level) / ln(1 - {risk}::DOUBLE) AS pooled FROM s, level),
u AS (SELECT pooled, CASE WHEN NOT pooled THEN lang END AS member, n, unnest(tests) AS x FROM v),
k AS (SELECT pooled, member, x.t AS t, x.rule AS rule, x.cutoff AS cutoff, sum(n)::BIGINT AS n, sum(x.k)::BIGINT AS k FROM u GROUP BY ALL),
terms AS (SELECT *, unnest(range(0, k + 1)) AS j FROM k),
pv AS (SELECT pooled, member, t, rule, cutoff, CASE WHEN k >= n * {risk}::DOUBLE THEN 1 ELSE sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}::DOUBLE) + (n - j) * ln(1 - {risk}::DOUBLE))) END AS p
  FROM terms GROUP BY pooled, member, t, rule, cutoff, n, k),
walk AS (SELECT pv.*, min((p <= level)::INT) OVER (PARTITION BY pooled, member ORDER BY t) = 1 AS walked FROM pv, level),
found AS (SELECT pooled, member, {best} FROM walk GROUP BY ALL),
cut AS (SELECT v.lang, found.* FROM v JOIN found ON v.pooled = found.pooled AND (v.pooled OR v.lang IS NOT DISTINCT FROM found.member))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM (
  SELECT f.*, CASE WHEN base_failed THEN 'base' {fail} END AS failed_rule FROM f LEFT JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang)"""
