"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) are fixed patterns with checks.  Beyond them,
wider patterns propose candidates, and five labelers vote on each: its shape, a
checksum or digit rule, a gazetteer of cue words before it, the context's
punctuation, and how mixed its characters are.  Votes (yes, no, none) are counted
by pattern; expectation-maximisation on those counts (at most 3**5 patterns, all
candidates of the corpus) estimates each labeler's reliability, and the
posteriors train a final classifier over votes, kind and length, whose weights
score every candidate.  Candidates that overlap a base span add nothing.

Positions come from splitting the text at the pattern: the pieces between the
matches and the matches themselves, summed in code points.  The patterns are
possessive, or start only where a run of their characters starts, so long runs
cost linear time and no stack.

Null texts are empty.  Documents are told apart by doc_id and text; repeated rows
are each answered.  Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns, as linear-time equivalents.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Each hint is implied by its pattern: a text without it has no match.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}

# Candidate patterns beyond the base, and cue words.
EXTRA = {
    "secret": r"AKIA[0-9A-Z]{16}|(?<![A-Za-z0-9])(?:[0-9a-f]{16,64}|[0-9A-F]{16,64})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "tel": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
}
EXTRA_HINTS = {"secret": "AKIA|[0-9a-f]{16}|[0-9A-F]{16}", "ssn": "[0-9]{2}", "iban": "[0-9]{2}", "tel": "[0-9]{2}"}
CUES = r"(?i)(password|passwd|token|secret|key|api|ssn|social|iban|account|konto|compte|cuenta|phone|tel|call|mobile|fax|mail|card|login)"
COUNTERCUES = r"(?i)(version|section|page|chapter|license|licence|isbn|issn|figure|table|cc by)"
VOTES = ("shape", "rule", "cue", "mark", "mixed")
ORDER = (*KINDS, *EXTRA)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _small_parts(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def base_check(kind: Column, m: Column) -> Column:
    n = F.char_length(_digits(m))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", _small_parts(m))
        .when(kind == "card", F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def _matches(text: Column, kind: str, pattern: str, hint: str | None) -> Column:
    """Array of (kind, i, gap, match, before): gap is the length of the piece
    before the i-th match, before its last characters."""
    some = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.char_length(p).alias("gap"), F.right(p, F.lit(24)).alias("before")))
    rows = F.zip_with(some, F.slice(gaps, 1, F.greatest(F.size(some), F.lit(0))), lambda m, g: F.struct(F.lit(kind).alias("kind"), g["gap"].alias("gap"), m.alias("match"), g["before"].alias("before")))
    rows = F.transform(rows, lambda r, i: F.struct(r["kind"].alias("kind"), i.alias("i"), r["gap"].alias("gap"), r["match"].alias("match"), r["before"].alias("before")))
    empty = F.expr("cast(array() as array<struct<kind:string,i:int,gap:int,match:string,before:string>>)")
    return F.when(text.rlike(hint), rows).otherwise(empty) if hint else rows


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, kind, start, stop, match, before), of base and extra kinds."""
    text = F.col("text")
    found = F.concat(
        *[_matches(text, k, PATTERNS[k], HINTS[k]) for k in KINDS],
        *[_matches(text, k, p, EXTRA_HINTS[k]) for k, p in EXTRA.items()],
    )
    rows = docs.select("doc_id", "_text", F.explode_outer(found).alias("m")).where("m IS NOT NULL").select("doc_id", "_text", "m.*").distinct()
    run = Window.partitionBy("doc_id", "_text", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("match")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + size).over(run))
    return rows.select("doc_id", "_text", "kind", (F.col("stop") - size).alias("start"), "stop", "match", "before")


def votes(c: DataFrame) -> DataFrame:
    """Adds the labelers' votes: 1, 0, or -1 for none."""
    m, before, n = F.col("match"), F.col("before"), F.char_length("match")
    digits = F.char_length(_digits(m))
    yes, no, none = F.lit(1), F.lit(0), F.lit(-1)
    return c.withColumns({
        "v_shape": F.when(F.col("kind") == "secret", F.when(m.startswith("AKIA") | n.isin(20, 32, 40, 64), yes).otherwise(none)).when(F.col("kind").isin("ssn", "iban") | m.startswith("("), yes).otherwise(none),
        "v_rule": F.when(F.col("kind") == "iban", F.when(digits >= 10, yes).otherwise(no)).when(F.col("kind") == "ssn", F.when(m.rlike("^(000|666|9)"), no).otherwise(yes)).when(F.col("kind") == "tel", F.when(digits == 10, yes).otherwise(no)).when(digits < 3, no).otherwise(none),
        "v_cue": F.when(before.rlike(CUES), yes).when(before.rlike(COUNTERCUES), no).otherwise(none),
        "v_mark": F.when(before.rlike(r"[=:][\x20\"']*$"), yes).when(before.rlike(r"[#/$]$"), no).otherwise(none),
        "v_mixed": F.when((digits > 0) & (digits < n) & (n >= 16), yes).when(digits == n, no).otherwise(none),
        "bin": F.least(F.floor(n / 8), F.lit(5)).cast("int"),
    })


def reliabilities(table: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[list[list[float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over (votes, count): the share of true spans,
    P(vote | truth) of each labeler, and the posterior of each pattern."""
    total = sum(n for _, n in table)
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * (v.count(1) - v.count(0)))) for v, _ in table}
    share, rates = 0.5, []
    for _ in range(rounds):
        share = (1 + sum(n * post[v] for v, n in table)) / (total + 2)
        rates = []
        for j in range(len(VOTES)):
            by = [[0.5, 0.5, 0.5], [0.5, 0.5, 0.5]]
            for v, n in table:
                by[1][v[j] + 1] += n * post[v]
                by[0][v[j] + 1] += n * (1 - post[v])
            rates.append([[x / sum(row) for x in row] for row in by])
        for v, _ in table:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[j][1][x + 1] / rates[j][0][x + 1]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, rates, post


def train(counted: list[tuple[tuple[int, ...], str, int, int]]) -> dict[str, dict[object, float]]:
    """Final classifier: log-odds weights of votes, kind and length bin, from
    the posteriors (naive Bayes with expected counts)."""
    by_votes: dict[tuple[int, ...], int] = {}
    for v, _, _, n in counted:
        by_votes[v] = by_votes.get(v, 0) + n
    if not by_votes:
        return {}
    share, _, post = reliabilities(sorted(by_votes.items()))
    sums: dict[str, dict[object, list[float]]] = {}
    for v, kind, size, n in counted:
        for feature, value in [*zip((f"v_{x}" for x in VOTES), v, strict=True), ("kind", kind), ("bin", size)]:
            cell = sums.setdefault(feature, {}).setdefault(value, [0.5, 0.5])
            cell[1] += n * post[v]
            cell[0] += n * (1 - post[v])
    out: dict[str, dict[object, float]] = {"prior": {0: math.log(share / (1 - share))}}
    for feature, cells in sums.items():
        up, down = (sum(c[i] for c in cells.values()) for i in (1, 0))
        out[feature] = {value: math.log((c[1] / up) / (c[0] / down)) for value, c in cells.items()}
    return out


def log_odds(weights: dict[str, dict[object, float]]) -> Column:
    score = F.lit(float(weights["prior"][0]))
    for feature, cells in weights.items():
        if feature != "prior":
            part = F.lit(0.0)
            for value, w in cells.items():
                part = F.when(F.col(feature) == F.lit(value), F.lit(float(w))).otherwise(part)
            score = score + part
    return score


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _text, base and spans (arrays of start, rank, kind, stop), for
    every document row."""
    from boxloom.llm.common import written

    marked = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    every = written(candidates(marked), "pii")
    base = every.where(F.col("kind").isin(*KINDS)).where(base_check(F.col("kind"), F.col("match"))).withColumn("added", F.lit(False))
    extra = votes(every.where(F.col("kind").isin(*EXTRA)))
    # at most 3**5 patterns by 4 kinds by 6 lengths
    counted = extra.groupBy(*[f"v_{x}" for x in VOTES], "kind", "bin").count().collect()
    weights = train([(tuple(r[f"v_{x}"] for x in VOTES), r["kind"], r["bin"], r["count"]) for r in counted])
    spans = base.select("doc_id", "_text", "kind", "start", "stop", "added")
    if weights:
        spans = spans.unionByName(extra.where(log_odds(weights) > 0).select("doc_id", "_text", "kind", "start", "stop", F.lit(True).alias("added")))
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    item = F.struct("start", rank.alias("rank"), "kind", "stop", "added")
    per = spans.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_list(item)).alias("_all"))  # bounded by the text
    # sorted by start: an added span goes where the furthest end before it, or the next base start, reaches into it
    per = per.withColumn("_base", F.filter("_all", lambda s: ~s["added"]))
    free = lambda s: ~s["added"] | ~F.exists(F.col("_base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    per = per.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "_base", F.filter("_all", free).alias("_spans"))
    slim = marked.select("doc_id", "_text")
    return slim.join(per, slim["doc_id"].eqNullSafe(per["_id"]) & (slim["_text"] == per["_t"]), "left")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of
    all kinds)."""
    out = find_spans(docs)
    count = {f"n_{k}": F.coalesce(F.size(F.filter("_base", _is(k))), F.lit(0)).cast("long") for k in KINDS}
    count = {n: F.when(F.col("_base").isNull(), F.lit(0).cast("long")).otherwise(c) for n, c in count.items()}
    text = lambda c: F.coalesce(joined_spans(F.col(c)), F.lit(""))
    return out.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(text("_base"), 256).alias("base_sha256"), text("_spans").alias("spans"), F.greatest(F.coalesce(F.size("_spans"), F.lit(0)), F.lit(0)).cast("long").alias("n_spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
