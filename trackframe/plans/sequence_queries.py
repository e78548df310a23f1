"""Queries of sequences, variants and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions import sequences as s
from trackframe.operators import dist, ensembles, intervals, matrix, pairs, variants
from trackframe.plans import views as v
from trackframe.plans.metric_queries import r6
from trackframe.plans.registry import query
from trackframe.sources import readers

RC = "reverse(translate(seq, 'ATCGatcg', 'TAGCtagc'))"


def _column(name, sql, make):
    """A query of one string column of every sequence."""
    query(name, f"SELECT seq_id, {sql} AS value FROM seqs", "seqs")(lambda spark, d: v.seqs(spark, d).select("seq_id", make(F.col("seq")).alias("value")))


_column("seq1_reverse_complement", RC, s.reverse_complement)
_column("seq1_strand_sequence", f"CASE WHEN seq_id % 2 = 0 THEN {RC} ELSE seq END", lambda q: s.strand_sequence(q, F.when(F.col("seq_id") % 2 == 0, "-").otherwise("+")))
_column("seq3_index_encode", "array_to_string(list_transform(string_split(seq, ''), lambda c: CASE WHEN strpos('ACGT', c) = 0 THEN 4 ELSE strpos('ACGT', c) - 1 END), '')", lambda q: F.array_join(F.transform(s.index_codes(q), lambda c: c.cast("string")), ""))
_column(
    "seq3_index_encode_sampled",
    "array_to_string(list_transform(string_split(seq, ''), lambda c, i: CASE WHEN strpos('ACGT', c) = 0 THEN ('0x' || substr(md5(seq_id || '|' || (i - 1) || '|7'), 1, 8))::BIGINT % 4 ELSE strpos('ACGT', c) - 1 END), '')",
    lambda q: F.array_join(F.transform(s.sampled_codes(q, F.col("seq_id"), 7), lambda c: c.cast("string")), ""),
)
_column("seq4_decode_one_hot", "regexp_replace(seq, '[^ACGT]', 'N', 'g')", lambda q: s.decode_one_hot(s.one_hot(q)))
_column("seq4_get_base", "CASE WHEN length(seq) > 3 THEN regexp_replace(substr(seq, 4, 1), '[^ACGT]', 'N') END", lambda q: s.base_at(s.one_hot(q), 3))
SHIFT = "CASE WHEN seq_id % 7 >= 3 THEN repeat('N', least(seq_id % 7 - 3, length(seq))::INT) || substr(seq, 1, length(seq) - (seq_id % 7 - 3)) ELSE substr(seq, (3 - seq_id % 7 + 1)) || repeat('N', least(3 - seq_id % 7, length(seq))::INT) END"
_column("seq6_shift_sequence", SHIFT.replace("length(seq) - (seq_id % 7 - 3)", "greatest(length(seq) - (seq_id % 7 - 3), 0)"), lambda q: s.shift_sequence(q, (F.col("seq_id") % 7 - 3).cast("int")))
_column("seq7_delete_bases", "rpad(substr(seq, 1, 5) || substr(seq, 9), length(seq)::INT, 'N')", lambda q: s.delete_bases(q, F.lit(5), F.lit(3)))
_column("seq8_insert_bases", "substr(substr(seq, 1, 5) || 'TTAA' || substr(seq, 6), 1, length(seq))", lambda q: s.insert_bases(q, F.lit(5), F.lit("TTAA")))
_column("seq9_set_base", "CASE WHEN length(seq) > 4 THEN substr(seq, 1, 4) || 'G' || substr(seq, 6) END", lambda q: s.set_base(q, F.lit(4), F.lit("G")))
_column("prj3_pad_with_n", "rpad(repeat('N', (seq_id % 5)::INT) || seq, 600, 'N')", lambda q: dist.pad_with_n(q, -(F.col("seq_id") % 5), F.lit(600)))


@query("seq2_one_hot_table", """WITH f AS (SELECT seq_id, CASE WHEN length(seq) >= 100 THEN substr(seq, ((length(seq) - 100) // 2 + 1)::INT, 100) ELSE rpad(repeat('.', ((100 - length(seq)) // 2)::INT) || seq, 100, '.') END AS q FROM seqs),
p AS (SELECT seq_id, i::INT AS pos, substr(q, i + 1, 1) AS c FROM f, range(0, 100) r(i))
SELECT seq_id, pos, b::INT AS base, CASE WHEN c = substr('ACGT', b + 1, 1) THEN 1.0 WHEN c IN ('A', 'C', 'G', 'T', '.') THEN 0.0 ELSE 0.25 END::DOUBLE AS value FROM p, range(0, 4) s(b)""", "seqs")
def _(spark, d):
    return s.one_hot_table(v.seqs(spark, d), 100, 0.25)


FIT = "CASE WHEN length(seq) >= 100 THEN substr(seq, ((length(seq) - 100) // 2 + 1)::INT, 100) ELSE rpad(repeat('.', ((100 - length(seq)) // 2)::INT) || seq, 100, '.') END"


@query("seq5_one_hot_rc", f"""WITH p AS (SELECT seq_id, i::INT AS pos, substr(reverse(translate({FIT}, 'ACGT', 'TGCA')), i + 1, 1) AS c FROM seqs, range(0, 100) r(i))
SELECT seq_id, pos, b::INT AS base, CASE WHEN c = substr('ACGT', b + 1, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM p, range(0, 4) s(b)""", "seqs")
def _(spark, d):
    return s.one_hot_reverse_complement(s.one_hot_table(v.seqs(spark, d), 100), F.lit(100)).select("seq_id", "pos", "base", "value")


@query("seq2_one_hot_whole", """WITH p AS (SELECT seq_id, i::INT AS pos, substr(seq, i + 1, 1) AS c FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS i FROM seqs))
SELECT seq_id, pos, b::INT AS base, CASE WHEN c = substr('ACGT', b + 1, 1) THEN 1.0 WHEN c IN ('A', 'C', 'G', 'T', '.') THEN 0.0 ELSE 0.25 END::DOUBLE AS value FROM p, range(0, 4) s(b)""", "seqs")
def _(spark, d):
    return s.one_hot_table(v.seqs(spark, d), None, 0.25)


@query("seq5_one_hot_rc_whole", """WITH p AS (SELECT seq_id, i::INT AS pos, substr(reverse(translate(seq, 'ACGT', 'TGCA')), i + 1, 1) AS c FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS i FROM seqs))
SELECT seq_id, pos, b::INT AS base, CASE WHEN c = substr('ACGT', b + 1, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM p, range(0, 4) s(b)""", "seqs")
def _(spark, d):
    x = v.seqs(spark, d).withColumn("n", F.length("seq"))
    return s.one_hot_reverse_complement(s.one_hot_table(x, keep=("n",)), F.col("n")).select("seq_id", "pos", "base", "value")


@query("seq2_one_hot_sampled", """WITH p AS (SELECT seq_id, i::INT AS pos, substr(seq, i + 1, 1) AS c FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS i FROM seqs)),
k AS (SELECT seq_id, pos, CASE WHEN strpos('ACGT', c) = 0 THEN ('0x' || substr(md5(seq_id || '|' || pos || '|5'), 1, 8))::BIGINT % 4 ELSE strpos('ACGT', c) - 1 END AS code FROM p)
SELECT seq_id, pos, b::INT AS base, CASE WHEN code = b THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM k, range(0, 4) s(b)""", "seqs")
def _(spark, d):
    return s.one_hot_table(v.seqs(spark, d), sample=5)


@query("seq6_shift_table", """WITH p AS (SELECT seq_id, seq, unnest(range(0, length(seq))) AS i, seq_id % 7 - 3 AS k FROM seqs)
SELECT seq_id, i::INT AS pos, b::INT AS base, CASE WHEN i - k < 0 OR i - k >= length(seq) THEN 0.25 WHEN substr(seq, (i - k + 1)::INT, 1) = substr('ACGT', b + 1, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM p, range(0, 4) s(b)""", "seqs")
def _(spark, d):
    x = v.seqs(spark, d).withColumn("by", F.col("seq_id") % 7 - 3).withColumn("n", F.length("seq"))
    return s.shift_table(s.one_hot_table(x, keep=("by", "n")), "by", "n").select("seq_id", "pos", "base", "value")


@query("seq6_shift_packed", """WITH p AS (SELECT seq_id, length(seq) AS n, CASE WHEN seq_id % 7 >= 3 THEN repeat('x', least(seq_id % 7 - 3, length(seq))::INT) || substr(seq, 1, greatest(length(seq) - (seq_id % 7 - 3), 0)) ELSE substr(seq, 3 - seq_id % 7 + 1) || repeat('x', least(3 - seq_id % 7, length(seq))::INT) END AS q FROM seqs)
SELECT seq_id, n::INT AS size, regexp_replace(q, '[^ACGT]', 'N', 'g') AS letters, (length(q) - length(replace(q, 'x', ''))) * 2.0 + length(regexp_replace(q, '[^ACGT]', '', 'g'))::DOUBLE AS total FROM p""", "seqs")
def _(spark, d):
    """Laid bare positions hold a half in each base."""
    moved = v.seqs(spark, d).select("seq_id", s.shift_packed(s.one_hot(F.col("seq")), F.col("seq_id") % 7 - 3, 0.5).alias("rows"))
    return moved.select("seq_id", F.size("rows").alias("size"), s.decode_one_hot(F.col("rows")).alias("letters"), F.aggregate(F.flatten("rows"), F.lit(0.0), lambda a, x: a + x).alias("total"))


EDITS = "SELECT seq_id, seq, seq_id % 300 AS p, substr('ACGTNX', (seq_id % 6 + 1)::INT, 1) AS b FROM seqs"


@query("seq9_set_bases_counted", f"""WITH e AS ({EDITS})
SELECT seq_id, CASE WHEN b IN ('A', 'C', 'G', 'T') AND p < length(seq) THEN substr(seq, 1, p::INT) || b || substr(seq, (p + 2)::INT) END AS value,
  (SELECT count(*) FROM e WHERE b IN ('N', 'X')) AS invalid_letters, (SELECT count(*) FROM e WHERE p >= length(seq)) AS outside FROM e""", "seqs")
def _(spark, d):
    """A third of the letters are none; what was counted as the result was written stands beside it."""
    from trackframe.plans.table_queries import scratch

    base = F.substring(F.lit("ACGTNX"), (F.col("seq_id") % 6 + 1).cast("int"), F.lit(1))
    edited, seen = s.set_bases_counted(v.seqs(spark, d), (F.col("seq_id") % 300).cast("int"), base, "value")
    at = scratch(spark, "edited")
    edited.select("seq_id", "value").write.parquet(at)
    told = seen.get
    return spark.read.schema("seq_id long, value string").parquet(at).select("seq_id", "value", *(F.lit(told[c]).alias(c) for c in ("invalid_letters", "outside")))


DRAW = "('0x' || substr(md5(seq_id || '|3|11|{k}'), 1, 8))::BIGINT"


@query("seq10_stochastic_augment", f"""WITH a AS (SELECT seq_id, seq, {DRAW.format(k='rc')} % 2 = 1 AS is_rc, ({DRAW.format(k='shift')} % 7 - 3)::INT AS shift FROM seqs),
m AS (SELECT seq_id, is_rc, shift, CASE WHEN shift >= 0 THEN repeat('N', least(shift, length(seq))::INT) || substr(seq, 1, greatest(length(seq) - shift, 0)) ELSE substr(seq, 1 - shift) || repeat('N', least(-shift, length(seq))::INT) END AS seq FROM a)
SELECT seq_id, is_rc, shift, CASE WHEN is_rc THEN {RC} ELSE seq END AS aug_seq FROM m""", "seqs")
def _(spark, d):
    return s.stochastic_augment(v.seqs(spark, d), 3, 11).drop("seq")


VARIANTS = """v AS (SELECT seq_id, i::INT AS pos, substr(seq, i + 1, 1) AS ref, b AS base, substr(seq, 1, i) || b || substr(seq, i + 2) AS mut_seq, seq FROM seqs, range(10, 14) r(i), (VALUES ('A'), ('C'), ('G'), ('T')) w(b)
WHERE i < length(seq) AND substr(seq, i + 1, 1) IN ('A', 'C', 'G', 'T') AND substr(seq, i + 1, 1) <> b)"""


@query("seq11_saturation_variants", f"WITH {VARIANTS} SELECT seq_id, pos, ref, base, mut_seq FROM v", "seqs")
def _(spark, d):
    return s.saturation_variants(v.seqs(spark, d), 10, 14)


NUMBER = "('0x' || substr(md5(seq_id || '|' || pos || '|' || sample || '|' || {i} || '|0'), 1, 8))::BIGINT"
PAIRS = "list_filter(list_concat([CASE WHEN sample % 2 = 1 THEN substr(p, 1, 1) ELSE '' END], list_transform(range(0, (length(substr(p, 1 + sample % 2)) + 1) // 2), lambda j: substr(substr(p, 1 + sample % 2), 2 * j + 1, 2))), lambda x: x <> '')"
SHUFFLED = "array_to_string(list_transform(list_sort(list_transform({blocks}, lambda x, i: {{'h': {number}, 'i': i, 'x': x}})), lambda e: e.x), '')".replace("{number}", NUMBER.format(i="(i - 1)"))
DRAWN = {
    "random": f"array_to_string(list_transform(range(0, length(p)), lambda i: substr('ACGT', ({NUMBER.format(i='i')} % 4 + 1)::INT, 1)), '')",
    "mono": SHUFFLED.format(blocks="list_filter(string_split(p, ''), lambda x: x <> '')"),
    "dinuc": SHUFFLED.format(blocks=PAIRS),
}


def shuffled(mode: str, samples: int) -> str:
    """SQL of shuffle_variants over [10, 13) with windows of 6."""
    return f"""SELECT seq_id, pos, sample, substr(seq, 1, lo) || {DRAWN[mode]} || substr(seq, hi + 2) AS mut_seq, seq FROM (SELECT *, substr(seq, lo + 1, hi - lo + 1) AS p FROM (
SELECT seq_id, seq, i::INT AS pos, k::INT AS sample, greatest(i - 3, 0)::INT AS lo, least(i + 3, length(seq) - 1)::INT AS hi FROM seqs, range(10, 13) r(i), range(0, {samples}) q(k) WHERE i < length(seq)))"""


@query("seq12_shuffle_variants", " UNION ALL ".join(f"SELECT seq_id, pos, sample, mut_seq, '{m}' AS mode FROM ({shuffled(m, 2)})" for m in DRAWN), "seqs")
def _(spark, d):
    x = v.seqs(spark, d)
    modes = [s.shuffle_variants(x, 10, 13, 6, 2, m).withColumn("mode", F.lit(m)) for m in ("random", "mono", "dinuc")]
    return modes[0].union(modes[1]).union(modes[2])


@query("seq13_base_names", "SELECT DISTINCT gene_id || '.Rp' AS gene, gene_id AS base, true AS is_reverse, 'exp_' || target_idx AS experiment FROM seed_preds", "seed_preds")
def _(spark, d):
    x = v.seed_preds(spark, d).select(F.concat("gene_id", F.lit(".Rp")).alias("gene"), F.concat(F.lit("exp_"), "target_idx", F.lit("_seed_"), "seed").alias("name"))
    return x.select("gene", s.base_gene(F.col("gene")).alias("base"), s.is_reverse(F.col("gene")).alias("is_reverse"), s.base_experiment(F.col("name")).alias("experiment")).distinct()


@query("seq14_parse_prediction_key", "SELECT DISTINCT target_idx::INT AS target, seed::INT AS seed FROM seed_preds", "seed_preds")
def _(spark, d):
    x = v.seed_preds(spark, d).select(F.concat(F.lit("target_"), "target_idx", F.lit("_seed_"), "seed").alias("key"))
    k, m = s.prediction_key(F.col("key"))
    return x.select(k.alias("target"), m.alias("seed")).distinct()


# ---- in-silico mutagenesis: a position-weight score of A, C, G, T and others -----------------------------
GC = "((length(x) - length(replace(x, 'G', ''))) * 2.0 + (length(x) - length(replace(x, 'C', ''))) * 1.0 + (length(x) - length(replace(x, 'A', ''))) * 0.5)::DOUBLE"


def letter_score(seq):
    n = lambda b: F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit("")))
    return n("G") * 2.0 + n("C") * 1.0 + n("A") * 0.5


def _deltas(spark, d):
    x = v.seqs(spark, d)
    folds = F.explode(F.array(F.lit(0), F.lit(1))).alias("fold")  # a variant is scored once, then taken to its folds
    mut = s.saturation_variants(x, 10, 14).select("seq_id", "pos", "base", letter_score(F.col("mut_seq")).alias("m")).select("*", folds).select("seq_id", "pos", "base", "fold", (F.col("m") * (F.col("fold") + 1)).alias("score_mut"))
    wild = x.select("seq_id", letter_score(F.col("seq")).alias("w")).select("*", folds).select("seq_id", "fold", (F.col("w") * (F.col("fold") + 1)).alias("score_wt"))
    return variants.variant_deltas(wild, mut, ["seq_id", "fold"])


DELTAS = f"WITH {VARIANTS}, dl AS (SELECT seq_id, pos, base, f::INT AS fold, {GC.replace('(x', '(seq')} * (f + 1) - {GC.replace('(x', '(mut_seq')} * (f + 1) AS delta FROM v, range(0, 2) g(f))"


@query("join13_variant_deltas", f"{DELTAS} SELECT seq_id, pos, base, fold, round(delta, 6) AS delta FROM dl", "seqs")
def _(spark, d):
    return r6(_deltas(spark, d).select("seq_id", "pos", "base", "fold", "delta"), "delta")


@query("agg31_ism_importance", f"{DELTAS} SELECT seq_id, pos, round(avg(x), 6) AS importance FROM (SELECT seq_id, pos, fold, sum(delta) / 4 AS x FROM dl GROUP BY ALL) GROUP BY ALL", "seqs")
def _(spark, d):
    """Both scores of a variant come from one row, which is then taken to its folds."""
    change = variants.window_deltas(s.window_variants(v.seqs(spark, d), 5, 10, 14), letter_score)
    folds = change.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold")).withColumn("delta", F.col("delta") * (F.col("fold") + 1))
    return r6(variants.ism_importance(folds), "importance")


WEIGHT = "CASE {} WHEN 'G' THEN 2.0 WHEN 'C' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END"


@query("agg31_ism_importance_whole", f"""WITH p AS (SELECT seq_id, pos, substr(seq, pos + 1, 1) AS ref FROM (SELECT seq_id, seq, unnest(range(0, length(seq)))::INT AS pos FROM seqs))
SELECT seq_id, pos, round(sum({WEIGHT.format('ref')} - {WEIGHT.format('b')}) / 4, 6) AS importance FROM p, (VALUES ('A'), ('C'), ('G'), ('T')) w(b) WHERE ref IN ('A', 'C', 'G', 'T') AND b <> ref GROUP BY ALL""", "seqs")
def _(spark, d):
    """Every position of every sequence, scored by the five letters on either side."""
    change = variants.window_deltas(s.window_variants(variants.by_sequence(v.seqs(spark, d)), 5), letter_score).withColumn("fold", F.lit(0))
    return r6(variants.ism_importance(change), "importance")


@query("agg32_shuffle_importance", f"SELECT seq_id, pos, round(avg({GC.replace('(x', '(seq')} - {GC.replace('(x', '(mut_seq')}), 6) AS importance FROM ({shuffled('random', 3)}) GROUP BY ALL", "seqs")
def _(spark, d):
    change = variants.window_deltas(s.window_shuffles(v.seqs(spark, d), 6, 3, "random", start=10, end=13), letter_score)
    return r6(variants.shuffle_importance(change), "importance")


SCORES = "SELECT gene_idx AS seq_id, target_idx // 4 AS pos, target_idx % 4 AS base, y_true AS value, CASE WHEN y_pred > 0 THEN 1.0 ELSE 0.0 END AS one_hot FROM mat"


def _scores(spark, d):
    return v.mat(spark, d).select(F.col("gene_idx").alias("seq_id"), F.floor(F.col("target_idx") / 4).alias("pos"), (F.col("target_idx") % 4).alias("base"), F.col("y_true").alias("value"), F.when(F.col("y_pred") > 0, 1.0).otherwise(0.0).alias("one_hot"))


@query("prj21_mean_subtract", f"SELECT seq_id, pos::BIGINT AS pos, base, round(value - avg(value) OVER (PARTITION BY seq_id, pos), 6) AS value FROM ({SCORES})", "mat")
def _(spark, d):
    return r6(matrix.mean_subtract(_scores(spark, d)).select("seq_id", "pos", "base", "value"), "value")


@query("prj21_input_gate", f"SELECT seq_id, pos::BIGINT AS pos, round(sum(value * one_hot), 6) AS value FROM ({SCORES}) GROUP BY ALL", "mat")
def _(spark, d):
    return r6(matrix.input_gate(_scores(spark, d)), "value")


@query("agg37_dominant_base", f"SELECT seq_id, pos::BIGINT AS pos, arg_max(base, abs(value)) AS base, round(sum(value), 6) AS total FROM ({SCORES}) GROUP BY ALL", "mat")
def _(spark, d):
    return r6(variants.dominant_base(_scores(spark, d)), "total")


@query("agg38_score_bounds", "SELECT round(lo - 0.05 * (hi - lo), 6) AS low, round(hi + 0.05 * (hi - lo), 6) AS high FROM (SELECT least(min(y_true), min(y_pred)) AS lo, greatest(max(y_true), max(y_pred)) AS hi FROM mat)", "mat")
def _(spark, d):
    m = v.mat(spark, d)
    return r6(variants.score_bounds(m.select(F.col("y_true").alias("value")), m.select(F.col("y_pred").alias("value"))), "low", "high")


FOLD_CHANGE = """WITH c AS (SELECT target_idx, seed, l_q, CASE WHEN seed % 2 = 0 THEN 'wt' ELSE 'mut' END AS kind FROM (SELECT l_linenumber AS target_idx, l_suppkey % 5 AS seed, l_partkey % 16 AS bin, avg(l_quantity) AS l_q FROM lineitem GROUP BY ALL)),
m AS (SELECT kind, target_idx, bin, avg(v) AS v FROM (SELECT CASE WHEN l_suppkey % 5 % 2 = 0 THEN 'wt' ELSE 'mut' END AS kind, l_suppkey % 5 AS fold, l_linenumber AS target_idx, l_partkey % 16 AS bin, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL),
s AS (SELECT target_idx, sum(v) FILTER (kind = 'mut') / sum(v) FILTER (kind = 'wt') AS change FROM m GROUP BY target_idx),
x AS (SELECT 'group' || target_idx % 3 AS description, round(avg(change), 4) AS fold_change FROM s GROUP BY ALL)
"""


def _fold_change(spark, d):
    li = v.t(spark, d, "lineitem")
    fold = F.col("l_suppkey") % 5
    cov = li.groupBy(F.when(fold % 2 == 0, "wt").otherwise("mut").alias("kind"), fold.alias("fold"), F.col("l_linenumber").alias("target_idx"), (F.col("l_partkey") % 16).alias("bin_idx")).agg(F.avg("l_quantity").alias("value"))
    names = li.select(F.col("l_linenumber").alias("target_idx")).distinct().withColumn("description", F.concat(F.lit("group"), (F.col("target_idx") % 3).cast("string")))
    return variants.fold_change(cov, names)


@query("agg25_fold_change_by_group", FOLD_CHANGE + "SELECT * FROM x")
def _(spark, d):
    return _fold_change(spark, d)


@query("sort2_order_by_fold_change", FOLD_CHANGE + "SELECT *, row_number() OVER (ORDER BY fold_change, description) AS place FROM x")
def _(spark, d):
    return variants.order_by_fold_change(_fold_change(spark, d))


# ---- intervals ------------------------------------------------------------------------------------
@query("prj1_center_windows", 'SELECT row_id, floor(("start" + "end") / 2)::BIGINT AS mid, floor(("start" + "end") / 2)::BIGINT - 500 AS win_start, floor(("start" + "end") / 2)::BIGINT + 500 AS win_end FROM bed', "bed")
def _(spark, d):
    return intervals.center_windows(v.bed(spark, d), 1000).select("row_id", "mid", "win_start", "win_end")


@query("prj2_per_base_windows", 'SELECT row_id, m AS mid, "end" - "start" AS interval_length, m - 64 AS win_start, m + 64 AS win_end FROM (SELECT *, unnest(range("start", "end")) AS m FROM bed)', "bed")
def _(spark, d):
    return intervals.per_base_windows(v.bed(spark, d), 128).select("row_id", "mid", "interval_length", "win_start", "win_end")


@query("prj10_to_bin", 'SELECT row_id, floor(("end" - "start" - 16) / 32)::BIGINT - 4 AS bin FROM bed', "bed")
def _(spark, d):
    return v.bed(spark, d).select("row_id", intervals.to_bin(F.col("end"), F.col("start"), 32, 16, 4).alias("bin"))


@query("prj11_bin_coordinates", 'SELECT row_id, "start" + 3 * 128 AS bin_start, "start" + 4 * 128 AS bin_end FROM bed', "bed")
def _(spark, d):
    a, b = intervals.bin_coordinates(F.col("start"), F.lit(3), 128)
    return v.bed(spark, d).select("row_id", a.alias("bin_start"), b.alias("bin_end"))


@query("prj23_filter_features", """SELECT * FROM ann WHERE (feature = 'R' AND strand = '+' AND "end" - "start" BETWEEN 60 AND 90) OR (feature = 'A' AND "end" - "start" BETWEEN 0 AND 70)""", "ann")
def _(spark, d):
    settings = spark.createDataFrame([("R", "+", 60, 90), ("A", None, 0, 70)], "feature string, strand string, min_length long, max_length long")
    return intervals.filter_features(v.ann(spark, d), settings)


def _overlap(mode, test):
    body = f"""SELECT b.row_id AS w_row_id, b.chrom AS w_chrom, b."start" AS w_start, b."end" AS w_end, a."start" AS f_start, a."end" AS f_end, a.strand AS f_strand, a.feature AS f_feature FROM bed b JOIN ann a ON a.chrom = b.chrom AND {test}"""

    @query(f"join4_interval_overlap_{mode}", body, "bed ann")
    def _(spark, d):
        return dist.overlap_join(v.bed(spark, d), v.ann(spark, d), mode).select("w_row_id", "w_chrom", "w_start", "w_end", "f_start", "f_end", "f_strand", "f_feature")


LONG_FEATURES = """SELECT 'chr' || (o_custkey % 5) AS chrom, floor(o_totalprice)::BIGINT - pow(10, o_orderkey % 9)::BIGINT AS "start", floor(o_totalprice)::BIGINT + pow(10, o_orderkey % 9)::BIGINT AS "end", o_orderkey AS feature FROM orders WHERE o_orderkey % 8 = 0"""


@query("join4_interval_overlap_long", f"""SELECT f.feature, count(*) AS n, sum(b.row_id)::BIGINT AS rows_sum, min(b."start") AS first FROM bed b JOIN ({LONG_FEATURES}) f ON f.chrom = b.chrom AND f."start" < b."end" AND b."start" < f."end" GROUP BY f.feature""", "bed")
def _(spark, d):
    """Features of 2 to 2 * 10**8 bases."""
    o = v.t(spark, d, "orders").where("o_orderkey % 8 = 0")
    far, at = F.pow(F.lit(10), F.col("o_orderkey") % 9).cast("long"), F.floor("o_totalprice")
    f = o.select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), (at - far).alias("start"), (at + far).alias("end"), F.col("o_orderkey").alias("feature"))
    return dist.overlap_totals(v.bed(spark, d), f, ["feature"], {"rows_sum": "row_id"})


_overlap("overlap", 'a."start" < b."end" AND b."start" < a."end"')
_overlap("endpoint", '(a."start" BETWEEN b."start" AND b."end" OR a."end" BETWEEN b."start" AND b."end")')


@query("src7_reference_tiles", "SELECT chrom, i AS tile_idx, substr(seq, i * 128 + 1, 128) AS seq FROM (SELECT 'd' || seq_id AS chrom, seq, unnest(range(0, (length(seq) - 1) // 128 + 1)) AS i FROM seqs)", "seqs")
def _(spark, d):
    return readers.reference_tiles(v.seqs(spark, d).select(F.concat(F.lit("d"), F.col("seq_id").cast("string")).alias("chrom"), "seq"), 128)


def _reference(spark, d):
    """Every sequence as a chromosome of its own, in tiles."""
    x = v.seqs(spark, d).withColumn("chrom", F.concat(F.lit("d"), F.col("seq_id").cast("string")))
    return x, readers.reference_tiles(x.select("chrom", "seq"), 128)


FETCHED = "rpad(repeat('N', greatest(-s, 0)::INT) || substr(seq, (greatest(s, 0) + 1)::INT, greatest(e - greatest(s, 0), 0)::INT), (e - s)::INT, 'N')"


@query("join5_fetch_windows", f"""WITH w AS (SELECT seq_id AS row_id, seq, seq_id % 50 - 20 AS s, seq_id % 50 + 180 AS e FROM seqs)
SELECT row_id, 'd' || row_id AS chrom, s AS "start", e AS "end", {FETCHED} AS seq FROM w""", "seqs")
def _(spark, d):
    x, tiles = _reference(spark, d)
    w = x.select(F.col("seq_id").alias("row_id"), "chrom", (F.col("seq_id") % 50 - 20).alias("start"), (F.col("seq_id") % 50 + 180).alias("end"))
    return dist.fetch_windows(w, tiles, 128)


# Lines of a BED file over the sequences: several lines hold the same interval, on either strand; some lie over three tiles, some outside.
LINES = "SELECT o_orderkey AS line, o_orderkey % 40 AS seq_id, o_custkey % 3 * 150 - 100 AS s, o_custkey % 3 * 150 - 100 + 90 * (o_orderkey % 4) AS e, CASE WHEN o_orderstatus = 'O' THEN '-' ELSE '+' END AS strand, o_orderpriority AS name FROM orders"


@query("join5_fetch_windows_repeated", f"""WITH w AS (SELECT l.*, q.seq FROM ({LINES}) l LEFT JOIN seqs q USING (seq_id)), f AS (SELECT *, CASE WHEN e > s THEN {FETCHED.replace('(seq,', "(coalesce(seq, ''),")} ELSE '' END AS fetched FROM w)
SELECT line, 'd' || seq_id AS chrom, s AS "start", e AS "end", strand, name, CASE WHEN strand = '-' THEN {RC.replace('seq', 'fetched')} ELSE fetched END AS seq FROM f""", "seqs")
def _(spark, d):
    o = v.t(spark, d, "orders")
    start = F.col("o_custkey") % 3 * 150 - 100
    lines = o.select(
        F.col("o_orderkey").alias("line"), F.concat(F.lit("d"), (F.col("o_orderkey") % 40).cast("string")).alias("chrom"), start.alias("start"), (start + 90 * (F.col("o_orderkey") % 4)).alias("end"),
        F.when(F.col("o_orderstatus") == "O", "-").otherwise("+").alias("strand"), F.col("o_orderpriority").alias("name"),
    )
    return dist.fetch_windows(lines, _reference(spark, d)[1], 128, strand="strand")


@query("set1_concat_annotations", 'SELECT chrom, "start", "end", strand, feature, NULL::BIGINT AS row_id FROM ann UNION ALL SELECT chrom, "start", "end", strand, NULL, row_id FROM bed', "ann bed")
def _(spark, d):
    return intervals.concat_annotations(v.ann(spark, d), v.bed(spark, d))


# ---- ensembles and pairs ---------------------------------------------------------------------------
MOVED = "CASE WHEN k >= 0 THEN repeat('N', least(k, length(seq))::INT) || substr(seq, 1, greatest(length(seq) - k, 0)) ELSE substr(seq, 1 - k) || repeat('N', least(-k, length(seq))::INT) END"


@query("join8_augment_shifts_rc", f"WITH a AS (SELECT seq_id, k::INT AS shift, rc AS is_rc, {MOVED} AS seq FROM seqs, (VALUES (-1), (0), (2)) s(k), (VALUES (true), (false)) r(rc)) SELECT seq_id, shift, is_rc, CASE WHEN is_rc THEN {RC} ELSE seq END AS seq FROM a", "seqs")
def _(spark, d):
    return ensembles.augment_shifts_rc(v.seqs(spark, d), [-1, 0, 2]).select("seq_id", "shift", "is_rc", "seq")


PAIRS = "SELECT a.gene_idx AS seq_id, a.target_idx AS i, b.target_idx AS j, a.y_true AS a, b.y_true AS b FROM mat a JOIN mat b ON a.gene_idx = b.gene_idx"


def _bins(spark, d):
    return v.mat(spark, d).select(F.col("gene_idx").alias("seq_id"), F.col("target_idx").alias("pos"), F.col("y_true").alias("value"))


for _name, _sql in (("mean", "(a + b) / 2"), ("max", "greatest(a, b)"), ("multiply", "a * b"), ("multiply1", "(a + 1) * (b + 1) - 1")):
    query(f"join14_pairwise_bins_{_name}", f"SELECT seq_id, i, j, round({_sql}, 6) AS value FROM ({PAIRS})", "mat")(lambda spark, d, n=_name: r6(pairs.pairwise_bins(_bins(spark, d), n), "value"))


@query("join15_pairwise_distance", f"SELECT seq_id, i, j, abs(i - j) AS distance FROM ({PAIRS})", "mat")
def _(spark, d):
    return pairs.pairwise_distance(pairs.pairwise_bins(_bins(spark, d), "mean")).select("seq_id", "i", "j", "distance")


@query("join16_upper_triangle", f"SELECT seq_id, i, j, round(a * b, 6) AS value FROM ({PAIRS}) WHERE j >= i + 2", "mat")
def _(spark, d):
    return r6(pairs.pairwise_bins(_bins(spark, d), "multiply", 2), "value")


@query("join17_symmetrize", f"SELECT seq_id, i, j, round((a * i + b * j) / 2, 6) AS value FROM ({PAIRS})", "mat")
def _(spark, d):
    p = pairs.pairwise_bins(_bins(spark, d).withColumn("value", F.col("value") * F.col("pos")), "concat").withColumn("value", F.col("value")[0])
    return r6(pairs.symmetrize(p), "value")


@query("join18_reverse_triangle", f"SELECT seq_id, 31 - j AS i, 31 - i AS j, round(a * b, 6) AS value FROM ({PAIRS}) WHERE j >= i + 2", "mat")
def _(spark, d):
    return r6(pairs.reverse_triangle(pairs.pairwise_bins(_bins(spark, d), "multiply", 2), 32), "value")


@query("agg24_attention_mean", "SELECT gene_idx AS seq_id, target_idx // 16 AS q, target_idx % 2 AS k, round(avg(y_true), 6) AS w FROM mat WHERE target_idx // 8 % 2 IN (0, 1) AND target_idx // 4 % 2 IN (1) AND target_idx // 2 % 2 IN (0, 1) GROUP BY ALL", "mat")
def _(spark, d):
    bit = lambda n: (F.floor(F.col("target_idx") / n) % 2).cast("int")
    a = v.mat(spark, d).select(F.col("gene_idx").alias("seq_id"), bit(8).alias("fold"), bit(4).alias("layer"), bit(2).alias("head"), F.floor(F.col("target_idx") / 16).cast("int").alias("q"), (F.col("target_idx") % 2).alias("k"), F.col("y_true").alias("w"))
    return r6(pairs.attention_mean(a, [0, 1], [1], [0, 1]), "w")


@query("join19_apply_components", "SELECT gene_idx AS row_idx, f AS feature, round(sum(y_true * (1 + (target_idx * f) % 5)), 6) AS value FROM mat, range(0, 3) r(f) GROUP BY ALL", "mat")
def _(spark, d):
    m = v.mat(spark, d)
    comp = m.select(F.col("target_idx").alias("component")).distinct().withColumn("feature", F.explode(F.expr("sequence(0L, 2L)"))).withColumn("c", (1 + (F.col("component") * F.col("feature")) % 5).cast("double"))
    return r6(pairs.apply_components(m.select(F.col("gene_idx").alias("row_idx"), F.col("target_idx").alias("component"), F.col("y_true").alias("w")), comp), "value")
