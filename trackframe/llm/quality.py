"""Quality rules whose cutoffs are certified on labelled holdouts; DataFrame and SQL operations only.

A rule rejects a document when a share of its text exceeds a cutoff; a document that any rule rejects goes. The labelled
texts are halved by a hash. On one half, per stratum (language), each rule gets the cutoff of a fixed grid that rejects
most bad texts for few good ones, and the rules are put in order of that merit. On the other half the joint
rule of the first, the first two, ... is tested in this order: the exact binomial tail P(X <= rejected | n good,
RISK) must be at most CONFIDENCE_LOSS / (number of strata). The first failure ends the sequence, so that no further
correction is needed within a stratum. With probability 1 - CONFIDENCE_LOSS, in no stratum does what is used
reject, all rules together, more than RISK of the good texts. A text counts once a stratum, however many copies and
labels it has (of these the worst). The labels are not used for anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import free_name, last_stays, materialize, quoted

RISK, CONFIDENCE_LOSS = 0.02, 0.05
#: A cutoff must reject at least this many labelled bad documents for each good one.
BAD_PER_GOOD = 10
#: Labelled doc_ids that are sent to the tasks at most; more are joined.
MOST_SENT = 1_000_000
#: Rule: (share as SQL over the statistics, cutoffs).
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    "upper_case": ("n_upper / word_chars", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "exclamation": ("n_exclaim / n_words", (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    "repeated_lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.6)),
    "repeated_words": ("n_repeat_words / n_words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.45)),
    "word_length": ("word_chars / n_words / 20.0", (0.35, 0.4, 0.5, 0.6, 0.8, 1.0)),
}
#: What separates words (space, 0x09-0x0D) and the symbols counted.
SPACES, SYMBOLS = r"[\\x20\\x09-\\x0D]+", "[#*$%&|<>]"

_REPEATS = """
CASE WHEN size(w) < 4 THEN 0L ELSE element_at(transform(array(
  transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE element_at(transform(array(
    array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
    aggregate(
      array_sort(transform(filter(s, (e, k) -> e.x = get(s, k - 1).x OR e.x = get(s, k + 1).x), e -> e.i)),
      struct(-3 AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n)), 1) END), 1) END"""
_COUNT = "cast(size(split(t, '{}', -1)) - 1 AS bigint)"
#: One pass over a text: words and lines are bound once by transform(array(...)).
STATS = f"""
element_at(transform(array(coalesce(cast(text AS string), '')), t ->
element_at(transform(array(array_remove(split(t, '{SPACES}'), '')), w ->
element_at(transform(array(filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')), l ->
named_struct(
  'n_words', cast(size(w) AS bigint), 'word_chars', cast(length(array_join(w, '')) AS bigint),
  'n_symbols', {_COUNT.format(SYMBOLS)}, 'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint),
  'n_repeat_words', {_REPEATS}, 'key', md5(t),
  'n_lines', cast(size(l) AS bigint), 'n_upper', {_COUNT.format("[A-Z]")}, 'n_exclaim', {_COUNT.format("[!?]")})), 1)), 1)), 1)"""
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def with_stats(docs: DataFrame, name: str = "stats") -> DataFrame:
    """docs with a struct of its texts' statistics (null text: no word).

    Word windows are compared by 64-bit hashes within one text.
    """
    return docs.withColumn(name, F.expr(STATS))


def share(rule: str, stats: str = "stats") -> F.Column:
    """A rule's share of a text; NULL (never rejected) where the text has no word."""
    above, *below = RULES[rule][0].split(" / ")
    out = F.col(f"{stats}.{above}").cast("double")
    for b in below:
        out = F.try_divide(out, F.col(f"{stats}.{b}") if b[0].isalpha() else F.lit(float(b)))
    return out


def stratum() -> F.Column:
    """A language each; a missing one is a stratum of its own."""
    return F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang")))


def certified_cutoffs(marked: DataFrame, labels: DataFrame, stats: str = "stats") -> DataFrame:
    """(stratum, one column a rule: cutoff or NULL) from marked(doc_id, lang, stats) and labels(doc_id, quality).

    Documents that the base rules reject don't count. Ties of merit go to the higher cutoff and to the first rule by
    name. The result has a row a language at most, and none for a language without a certified rule.
    """
    judged = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = marked.where(~F.expr(BASE_FAILED.replace("n_", f"{stats}.n_"))).select("doc_id", stratum().alias("stratum"), F.col(f"{stats}.key").alias("key"), *(share(r, stats).alias(r) for r in RULES))
    trials = passed.join(judged, "doc_id").groupBy("stratum", "key").agg(F.min("quality").alias("quality"), *(F.max(r).alias(r) for r in RULES))
    trials = materialize(trials.withColumn("chosen_on", F.col("key") < "8"), "trials")
    hit = lambda rule, c, good: F.count_if((F.col(rule) > c) & (F.col("quality") == good))
    merit = lambda rule, c: F.struct((hit(rule, c, 0) - BAD_PER_GOOD * hit(rule, c, 1)).alias("merit"), F.lit(c).alias("cutoff"), hit(rule, c, 0).alias("bad"))
    best = lambda rule, cuts: F.array_max(F.filter(F.array(*(merit(rule, c) for c in cuts)), lambda x: (x["bad"] > 0) & (x["merit"] >= 0)))
    picked = trials.where("chosen_on").groupBy("stratum").agg(*(best(r, cuts).alias(r) for r, (_, cuts) in RULES.items()))
    ranked = F.array_sort(F.filter(F.array(*(F.struct((-F.col(r)["merit"]).alias("m"), F.lit(r).alias("rule"), F.col(r)["cutoff"].alias("cutoff")) for r in sorted(RULES))), lambda x: x["cutoff"].isNotNull()))
    picked = materialize(picked.select("stratum", ranked.alias("ranked")), "picked")  # a row a language
    strata = trials.select("stratum").distinct().count()
    picked = F.broadcast(picked) if strata <= 10_000 else picked  # so that no task gets the texts of a language whole
    first = lambda r: F.coalesce(F.get(F.filter(F.transform("ranked", lambda x, i: F.struct(x["rule"].alias("rule"), x["cutoff"].alias("cutoff"), (i + 1).alias("at"))), lambda x: (x["rule"] == r) & (F.col(r) > x["cutoff"])), F.lit(0))["at"], F.lit(len(RULES) + 1))
    held = trials.where("not chosen_on and quality = 1").join(picked, "stratum").withColumn("at", F.least(*map(first, RULES)))
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col("at") <= k + 1) for k in range(len(RULES)))).alias("rejected"))
    tail = f"""aggregate(sequence(0, cast(good AS int)), named_struct('lp', cast(0 AS double), 's', cast(0 AS double)), (a, i) ->
        element_at(transform(array(if(i = 0, n * ln(1 - {RISK}D), a.lp + ln(n - i + 1) - ln(greatest(i, 1)) + ln({RISK}D / (1 - {RISK}D)))), lp ->
        named_struct('lp', lp, 's', a.s + exp(lp))), 1), a -> a.s)"""
    passes = F.expr(f"transform(rejected, good -> good <= n * {RISK}D AND {tail} <= {CONFIDENCE_LOSS / max(strata, 1)}D)")
    certified = counts.withColumn("passes", passes).select("stratum", F.expr("coalesce(nullif(array_position(passes, false), 0) - 1, size(passes))").alias("used"))
    use = picked.join(certified, "stratum").select("stratum", F.expr("slice(ranked, 1, cast(used AS int))").alias("ranked")).where("size(ranked) > 0")
    return use.select("stratum", *map(_cutoff, RULES))


def _cutoff(rule: str) -> F.Column:
    return F.get(F.filter("ranked", lambda x: x["rule"] == rule), F.lit(0))["cutoff"].alias(rule)


def judge(marked: DataFrame, cutoffs: DataFrame, stats: str = "stats", name: str = "verdict") -> DataFrame:
    """marked with `name`, a struct of base_failed and kept (never null); its own columns may have any other name."""
    free = free_name("judge_", marked)
    cuts = cutoffs.select(F.col("stratum").alias(f"{free}s"), F.struct(*RULES).alias(f"{free}c"))
    n = cutoffs.limit(10_001).count()  # a row a language: broadcast only after this check
    both = marked.join(F.broadcast(cuts) if n <= 10_000 else cuts, stratum() == F.col(f"{free}s"), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(share(r, stats) > F.col(f"{free}c.{r}"), F.lit(False))
    failed = F.expr(BASE_FAILED.replace("n_", f"{stats}.n_"))
    return both.withColumn(name, F.struct(failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))).drop(f"{free}s", f"{free}c")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs.

    Null text: no words (base_failed). Null lang is a stratum of its own; null doc_ids carry no label. Repeated rows
    are judged alike; without labels, or with too few to certify a cutoff, the base rules alone decide; an empty table
    gives none; other columns are ignored; texts of any length are read whole. Statistics are written once to
    the shared folder, as both the cutoffs and the verdicts need them.
    """
    marked = materialize(with_stats(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "stats"), "quality")
    cutoffs = materialize(certified_cutoffs(marked, labels), "cutoffs")
    return judge(marked, cutoffs).select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "verdict.base_failed", "verdict.kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_report keeps, with all their columns, whatever their names.

    The cutoffs are learned, and written, before; of the texts only the labelled ones are read for that. The verdicts are found
    as the result is read, so that no copy of the texts is made.
    """
    spark, name = docs.sparkSession, free_name("stats_", docs)
    ids = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("labelled_id")).distinct()
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    trained = docs.select("doc_id", "lang", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("labelled_id"), "left_semi")
    with last_stays(spark):
        marked = materialize(with_stats(trained).select("doc_id", "lang", "stats"), "quality")
        cutoffs = materialize(certified_cutoffs(marked, labels), "cutoffs")
    verdict = f"{name}verdict"
    return judge(with_stats(docs, name), cutoffs, name, verdict).where(f"{quoted(verdict)}.kept").select(*(F.col(quoted(c)) for c in docs.columns))


def _oracle() -> str:
    space = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shares = ", ".join("CASE WHEN n_words > 0 THEN " + e.replace(" / ", "::DOUBLE / ", 1).replace("n_lines", "nullif(n_lines, 0)") + f" END AS {r}" for r, (e, _) in RULES.items())
    tests = ", ".join(f"('{r}', {c})" for r, (_, cuts) in RULES.items() for c in cuts)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    cut = " OR ".join(f"coalesce({r} > c_{r}, false)" for r in RULES)
    first = "least(" + ", ".join(f"CASE WHEN {r} > c_{r} THEN at_{r} ELSE {len(RULES) + 1} END" for r in RULES) + ")"
    wide = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS c_{r}, max(place) FILTER (rule = '{r}') AS at_{r}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, stratum, t, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {space}) <> '') AS l FROM d),
g AS (SELECT rid, i, w[i:i+2] AS k, count(*) OVER (PARTITION BY rid, w[i:i+2]) AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY rid),
s AS (SELECT rid, doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  {count("#*$%&|<>")} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(l) AS n_lines, {count(upper)} AS n_upper, {count("!?")} AS n_exclaim, md5(t) AS key FROM w LEFT JOIN r USING (rid)),
f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {shares} FROM s),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
t AS MATERIALIZED (SELECT stratum, key, min(quality) AS quality, {", ".join(f"max({r}) AS {r}" for r in RULES)} FROM f JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY stratum, key),
c AS (SELECT stratum, rule, cutoff, count(*) FILTER (quality = 0 AND {value} > cutoff) AS bad, bad - {BAD_PER_GOOD} * count(*) FILTER (quality = 1 AND {value} > cutoff) AS merit
  FROM t, (VALUES {tests}) AS v(rule, cutoff) WHERE key < '8' GROUP BY ALL),
p AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY merit DESC, rule) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY merit DESC, cutoff DESC) AS o FROM c WHERE bad > 0 AND merit >= 0) WHERE o = 1),
pw AS (SELECT stratum, {wide} FROM p GROUP BY stratum),
h AS (SELECT stratum, {first} AS place FROM t JOIN pw USING (stratum) WHERE key >= '8' AND quality = 1),
n AS (SELECT stratum, k, count(*) AS n, count(*) FILTER (place <= k) AS good FROM h, range(1, {len(RULES) + 1}) r(k) GROUP BY ALL),
u AS (SELECT stratum, coalesce(min(k) FILTER (NOT ok), {len(RULES) + 1}) - 1 AS used FROM (SELECT *, good <= n * {RISK} AND
  list_sum(list_transform(range(0, good + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))
    <= {CONFIDENCE_LOSS} / (SELECT count(DISTINCT stratum) FROM t) AS ok FROM n) GROUP BY stratum),
k AS (SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS c_{r}" for r in RULES)} FROM p JOIN u USING (stratum) WHERE place <= used GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({cut}) AS kept
FROM f LEFT JOIN k USING (stratum)"""


ORACLE = _oracle()
