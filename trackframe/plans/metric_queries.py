"""Queries of metrics, losses, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import joins, losses, matrix, metrics, ordered
from trackframe.plans import views as v
from trackframe.plans.registry import query

SUMS = "SELECT {k}, count(*) AS n, sum(y_true) AS st, sum(y_pred) AS sp, sum(y_true * y_true) AS stt, sum(y_pred * y_pred) AS spp, sum(y_true * y_pred) AS stp FROM {t} GROUP BY {k}"
R = "CASE WHEN spp - sp * sp / n <= 1e-12 THEN 0 ELSE (stp - st * sp / n) / (sqrt(nullif(greatest(stt - st * st / n, 0), 0)) * sqrt(spp - sp * sp / n)) END"
R2 = "1 - (spp - 2 * stp + stt) / nullif(greatest(stt - st * st / n, 0), 0)"


def r6(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else c for c in df.columns))


#: Some truths and some predictions are missing; only rows with both count.
HOLES = "SELECT target, CASE WHEN y_true % 7 <> 0 THEN y_true END AS y_true, CASE WHEN y_true % 5 <> 0 THEN y_pred END AS y_pred FROM obs"


def holes(spark, d):
    y = F.col("y_true")
    return v.obs(spark, d).select("target", F.when(y % 7 != 0, y).alias("y_true"), F.when(y % 5 != 0, F.col("y_pred")).alias("y_pred"))


@query("agg1_metrics_with_missing_values", f"WITH h AS (SELECT * FROM ({HOLES}) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL) SELECT target, n, round({R}, 6) AS pearsonr, round({R2}, 6) AS r2 FROM ({SUMS.format(k='target', t='h')})", "obs")
def _(spark, d):
    return r6(metrics.by_target(holes(spark, d), ["target"]), "pearsonr", "r2")


@query("agg1_pearson_by_target", f"SELECT target, n, round({R}, 6) AS pearsonr FROM ({SUMS.format(k='target', t='obs')})", "obs")
def _(spark, d):
    return r6(metrics.by_target(v.obs(spark, d), ["target"]).select("target", "n", "pearsonr"), "pearsonr")


@query("agg2_r2_by_target", f"SELECT target, round({R2}, 6) AS r2 FROM ({SUMS.format(k='target', t='obs')})", "obs")
def _(spark, d):
    return r6(metrics.by_target(v.obs(spark, d), ["target"]).select("target", "r2"), "r2")


@query("agg3_summarize_metric", f"SELECT round(avg({R}), 6) AS pearsonr, round(avg({R2}), 6) AS r2 FROM ({SUMS.format(k='target', t='obs')})", "obs")
def _(spark, d):
    return r6(metrics.summarize(metrics.by_target(v.obs(spark, d), ["target"]), "pearsonr", "r2"), "pearsonr", "r2")


GENES = f"""SELECT gene_idx, n, CASE WHEN NOT flat THEN greatest(-1, least(1, {R})) END AS pearsonr, CASE WHEN NOT flat THEN CASE WHEN stt - st * st / n <= 1e-10 THEN 0 ELSE greatest(-1, least(1, {R2})) END END AS r2, flat AS constant
FROM (SELECT gene_idx, count(*) AS n, sum(y_true) AS st, sum(y_pred) AS sp, sum(y_true * y_true) AS stt, sum(y_pred * y_pred) AS spp, sum(y_true * y_pred) AS stp, stddev_pop(y_true) < 1e-10 OR stddev_pop(y_pred) < 1e-10 AS flat FROM mat GROUP BY gene_idx)"""


@query("agg4_metrics_by_gene", f"SELECT gene_idx, round(pearsonr, 6) AS pearsonr, round(r2, 6) AS r2, constant FROM ({GENES})", "mat")
def _(spark, d):
    return r6(metrics.by_gene(v.mat(spark, d)), "pearsonr", "r2")


RANKS = """SELECT gene_idx, rank() OVER (PARTITION BY gene_idx ORDER BY y_true) + (count(*) OVER (PARTITION BY gene_idx, y_true) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY gene_idx ORDER BY y_pred) + (count(*) OVER (PARTITION BY gene_idx, y_pred) - 1) / 2.0 AS b FROM mat"""


@query("agg5_spearman_by_gene", f"SELECT gene_idx, round(corr(a, b), 6) AS spearmanr FROM ({RANKS}) GROUP BY gene_idx", "mat")
def _(spark, d):
    return r6(metrics.spearman_by_gene(v.mat(spark, d)), "spearmanr")


@query("agg6_gene_metric_summary", f"SELECT count(*) AS n_genes, count(*) FILTER (constant) AS n_constant, round(avg(pearsonr), 6) AS pearsonr_mean, round(avg(r2), 6) AS r2_mean, round(100.0 * count(pearsonr) / count(*), 6) AS valid_percent FROM ({GENES})", "mat")
def _(spark, d):
    return r6(metrics.gene_summary(metrics.by_gene(v.mat(spark, d))), "pearsonr_mean", "r2_mean", "valid_percent")


CURVE = """WITH b AS (SELECT target, greatest(0, ceil(y_pred * 199) - 1)::INT AS bucket, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM clf GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY target) AS ap, sum(neg) OVER (PARTITION BY target) AS an FROM b WINDOW w AS (PARTITION BY target ORDER BY bucket DESC)),
e AS (SELECT *, lag(tp, 1, 0) OVER w AS tu, lag(fp, 1, 0) OVER w AS fu FROM c WINDOW w AS (PARTITION BY target ORDER BY bucket DESC))
"""


@query("agg7_auroc_by_target", CURVE + "SELECT target, round(sum((fp - fu) / an * (tp + tu) / ap / 2), 6) AS auroc FROM e GROUP BY target", "clf")
def _(spark, d):
    return r6(metrics.auroc(v.clf(spark, d)), "auroc")


@query("agg7_auroc_minoring_majoring", CURVE + "SELECT target, round(sum((fp - fu) / an * tu / ap), 6) AS minoring, round(sum((fp - fu) / an * tp / ap), 6) AS majoring FROM e GROUP BY target", "clf")
def _(spark, d):
    a, b = (metrics.auroc(v.clf(spark, d), summation=s).withColumnRenamed("auroc", s) for s in ("minoring", "majoring"))
    return r6(a.join(b, "target"), "minoring", "majoring")


@query("agg8_auprc_by_target", CURVE + """, s AS (SELECT *, tp + fp AS p, tu + fu AS u, coalesce((tp - tu) / nullif(tp + fp - tu - fu, 0), 0) AS slope FROM e)
SELECT target, round(sum(slope * (tp - tu + (tu - slope * u) * CASE WHEN u > 0 THEN ln(p / u) ELSE 0 END) / ap), 6) AS auprc FROM s GROUP BY target""", "clf")
def _(spark, d):
    return r6(metrics.auprc(v.clf(spark, d)), "auprc")


# A third of the predictions and some truths are missing: those rows count for nothing.
HOLES = "SELECT target, CASE WHEN k % 7 = 0 THEN NULL ELSE y_true END AS y_true, CASE WHEN k % 3 = 0 THEN NULL ELSE y_pred END AS y_pred FROM (SELECT l_returnflag AS target, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y_true, l_quantity / 51 AS y_pred, l_orderkey AS k FROM lineitem)"
FULL_ROWS = CURVE.replace("FROM clf", f"FROM ({HOLES}) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL")


def _holes(spark, d):
    k = F.col("l_orderkey")
    li = v.t(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("target"), F.when(k % 7 != 0, F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("y_true"), F.when(k % 3 != 0, F.col("l_quantity") / 51).alias("y_pred"))


@query("agg7_auroc_with_missing_values", FULL_ROWS + "SELECT target, round(sum((fp - fu) / an * (tp + tu) / ap / 2), 6) AS auroc FROM e GROUP BY target")
def _(spark, d):
    return r6(metrics.auroc(_holes(spark, d)), "auroc")


@query("agg8_auprc_with_missing_values", FULL_ROWS + """, s AS (SELECT *, tp + fp AS p, tu + fu AS u, coalesce((tp - tu) / nullif(tp + fp - tu - fu, 0), 0) AS slope FROM e)
SELECT target, round(sum(slope * (tp - tu + (tu - slope * u) * CASE WHEN u > 0 THEN ln(p / u) ELSE 0 END) / ap), 6) AS auprc FROM s GROUP BY target""")
def _(spark, d):
    return r6(metrics.auprc(_holes(spark, d)), "auprc")


@query("win7_reverse_cumulative", CURVE + "SELECT target, bucket, tp::BIGINT AS tp, fp::BIGINT AS fp, tu::BIGINT AS tp_up, fu::BIGINT AS fp_up FROM e", "clf")
def _(spark, d):
    return metrics.reverse_cumulative(metrics.roc_buckets(v.clf(spark, d))).select("target", "bucket", "tp", "fp", "tp_up", "fp_up")


@query("win4_average_rank", "SELECT gene_idx, target_idx, rank() OVER (PARTITION BY gene_idx ORDER BY y_true) + (count(*) OVER (PARTITION BY gene_idx, y_true) - 1) / 2.0 AS rank FROM mat", "mat")
def _(spark, d):
    return metrics.average_rank(v.mat(spark, d), "gene_idx", "y_true", "rank").select("gene_idx", "target_idx", F.col("rank").cast("double"))


@query("win4_average_rank_whole", "SELECT l_orderkey, l_linenumber, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def _(spark, d):
    """Three keys with all rows, fifty values: ranked by counted values."""
    return ordered.average_rank(v.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", "rank").drop("l_quantity")


@query("agg5_spearman_by_target", """SELECT target, round(corr(a, b), 6) AS spearmanr FROM (SELECT target, rank() OVER (PARTITION BY target ORDER BY y_true) + (count(*) OVER (PARTITION BY target, y_true) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY target ORDER BY y_pred) + (count(*) OVER (PARTITION BY target, y_pred) - 1) / 2.0 AS b FROM obs) GROUP BY target""", "obs")
def _(spark, d):
    return r6(metrics.spearman(v.obs(spark, d), ["target"]), "spearmanr")


@query("agg15_exact_quantiles", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS q01, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.999), 6) AS q999 FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    q = ordered.exact_quantiles(v.t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.999])
    return r6(q.select("l_returnflag", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("q01", "q50", "q999")))), "q01", "q50", "q999")


@query("win6_running_sum", """SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM lineitem""")
def _(spark, d):
    return ordered.running_sum(v.t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "upto", F.col("l_quantity").cast("long"), ("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "upto")


def _loss(name, sql, views, make):
    query(name, f"SELECT round(loss, 4) AS loss FROM ({sql})", views)(lambda spark, d: make(spark, d).select(F.round("loss", 4).alias("loss")))


POS = lambda s, d: v.pos_counts(s, d).withColumn("row", F.concat_ws("_", "seq_id", "pos"))
_loss("agg9_loss_mse", "SELECT avg(l) AS loss FROM (SELECT avg((y_true - y_pred) ^ 2) AS l FROM mat GROUP BY gene_idx)", "mat", lambda s, d: losses.loss("mse", v.mat(s, d), "gene_idx"))
_loss("agg9_loss_bce", "SELECT avg(l) AS loss FROM (SELECT avg(-(y_true * ln(q) + (1 - y_true) * ln(1 - q))) AS l FROM (SELECT target, y_true, least(greatest(y_pred, 1e-7), 1 - 1e-7) AS q FROM clf) GROUP BY target)", "clf", lambda s, d: losses.loss("bce", v.clf(s, d), "target"))
_loss("agg9_loss_poisson", "SELECT avg(l) AS loss FROM (SELECT avg(y_pred - y_true * ln(y_pred + 1e-7)) AS l FROM pos_counts GROUP BY seq_id)", "pos_counts", lambda s, d: losses.loss("poisson", v.pos_counts(s, d), "seq_id"))
_loss("agg10_loss_mse_udot", "SELECT avg(m - u) AS loss FROM (SELECT avg((y_true - y_pred) ^ 2) AS m, avg(y_true * y_pred) - avg(y_true) * avg(y_pred) AS u FROM mat GROUP BY gene_idx)", "mat", lambda s, d: losses.loss("mse_udot", v.mat(s, d), "gene_idx"))
_loss(
    "agg11_loss_poisson_kl",
    """WITH x AS (SELECT *, (y_true + 1e-7) / sum(y_true + 1e-7) OVER (PARTITION BY seq_id, pos) AS a, (y_pred + 1e-7) / sum(y_pred + 1e-7) OVER (PARTITION BY seq_id, pos) AS b FROM pos_counts)
SELECT avg(l) AS loss FROM (SELECT avg(y_pred - y_true * ln(y_pred + 1e-7)) + sum(a * ln(a / b)) AS l FROM x GROUP BY seq_id, pos)""",
    "pos_counts", lambda s, d: losses.loss("poisson_kl", POS(s, d), "row"),
)
MULTI = """WITH w AS (SELECT *, {w} AS w FROM pos_counts), y AS (SELECT seq_id, target_idx, pos, w, w * y_true AS t, w * y_pred AS p, sum(w * y_true) OVER g AS st, sum(w * y_pred) OVER g AS sp, sum(w) OVER g AS sw FROM w WINDOW g AS (PARTITION BY seq_id, target_idx))
SELECT avg(l){r} AS loss FROM (SELECT sum(-(t + 1e-7) * ln((p + 1e-7) / sp)) / any_value(sw) + {k} * any_value(sp - st * ln(sp + 1e-7)) / any_value(sw) AS l FROM y GROUP BY seq_id, target_idx)"""
_loss("agg12_loss_poisson_multinomial", MULTI.format(w="1.0::DOUBLE", r="", k="1"), "pos_counts", lambda s, d: losses.loss("poisson_mn", v.pos_counts(s, d), "seq_id", 8))
WEIGHT = "exp(-(((pos - 3.5) / (3.5 / ln(8) ^ 0.25)) ^ 4)) / exp(-((0.5 / (3.5 / ln(8) ^ 0.25)) ^ 4))"
_loss("agg12_loss_poisson_multinomial_weighted", MULTI.format(w=WEIGHT, r=" * 2 / 1.5", k="0.5"), "pos_counts", lambda s, d: losses.poisson_multinomial(v.pos_counts(s, d), "seq_id", 8, 0.5, 8.0, 4, True))


@query("prj26_position_weights", f"SELECT DISTINCT pos::INT AS pos, round({WEIGHT}, 6) AS weight FROM pos_counts", "pos_counts")
def _(spark, d):
    return v.pos_counts(spark, d).select(F.col("pos").cast("int").alias("pos")).distinct().withColumn("weight", F.round(losses.position_weight(F.col("pos"), 8, 8.0, 4), 6))


@query("udf2_loss_by_name", "SELECT 'mse' AS name, round(avg(l), 4) AS loss FROM (SELECT avg((y_true - y_pred) ^ 2) AS l FROM mat GROUP BY gene_idx) UNION ALL SELECT 'other', round(avg(l), 4) FROM (SELECT avg(y_pred - y_true * ln(y_pred + 1e-7)) AS l FROM pos_counts GROUP BY seq_id)", "mat pos_counts")
def _(spark, d):
    named = lambda n, df, row: losses.loss(n, df, row).select(F.lit(n).alias("name"), F.round("loss", 4).alias("loss"))
    return named("mse", v.mat(spark, d), "gene_idx").union(named("other", v.pos_counts(spark, d), "seq_id"))


@query("udf3_metric_state", "SELECT target, count(*) AS n, round(sum(y_true), 2) AS st, round(sum(y_pred), 2) AS sp FROM obs GROUP BY target", "obs")
def _(spark, d):
    return v.obs(spark, d).groupBy("target").agg(*metrics.moment_sums()).select("target", "n", F.round("st", 2).alias("st"), F.round("sp", 2).alias("sp"))


# ---- pooling and shaping of matrices -------------------------------------------------
LONG = lambda s, d: v.mat(s, d).select("gene_idx", F.col("target_idx").alias("pos"), F.col("y_true").alias("value"), F.col("y_pred").alias("score"))


@query("agg22_pool_bins", "SELECT gene_idx, (target_idx // 4)::BIGINT AS bin, round(avg(y_true), 6) AS value FROM mat GROUP BY ALL", "mat")
def _(spark, d):
    return r6(matrix.pool_bins(LONG(spark, d), 4, ["gene_idx"]), "value")


@query("agg23_quantile_scale", """WITH s AS (SELECT gene_idx, target_idx, y_true / quantile_cont(y_true, 0.95) OVER (PARTITION BY gene_idx) AS value FROM mat)
SELECT gene_idx, target_idx + 2 AS pos, round(value, 6) AS value FROM s UNION ALL SELECT DISTINCT gene_idx, unnest([0, 1, 34, 35]), 0.0 FROM s""", "mat")
def _(spark, d):
    scaled = matrix.quantile_scale(LONG(spark, d).drop("score"), ["gene_idx"], 0.95)
    return r6(matrix.pad_ends(scaled, ["gene_idx"], 32, 2), "value")


@query("agg33_global_pool", "SELECT gene_idx, round(avg(y_true), 6) AS mean, round(max(y_true), 6) AS max FROM mat GROUP BY gene_idx", "mat")
def _(spark, d):
    x = LONG(spark, d)
    return r6(matrix.global_pool(x, ["gene_idx"], "mean").withColumnRenamed("value", "mean").join(matrix.global_pool(x, ["gene_idx"], "max").withColumnRenamed("value", "max"), "gene_idx"), "mean", "max")


@query("agg34_softmax_pool", "SELECT gene_idx, round(sum(y_true * exp(y_pred)) / sum(exp(y_pred)), 6) AS value FROM mat GROUP BY gene_idx", "mat")
def _(spark, d):
    return r6(matrix.softmax_pool(LONG(spark, d), ["gene_idx"], "score"), "value")


@query("agg35_center_average", "SELECT gene_idx, round(avg(y_true), 6) AS value FROM mat WHERE target_idx BETWEEN 12 AND 19 GROUP BY gene_idx", "mat")
def _(spark, d):
    return r6(matrix.center_average(LONG(spark, d), ["gene_idx"], 32, 8), "value")


@query("agg36_length_average", "SELECT gene_idx, round(avg(y_true) / sum(CASE WHEN y_pred > 0 THEN 1 ELSE 0 END), 6) AS value FROM mat GROUP BY gene_idx", "mat")
def _(spark, d):
    return r6(matrix.length_average(LONG(spark, d).withColumn("known", F.when(F.col("score") > 0, 1).otherwise(0)), ["gene_idx"], "known"), "value")


@query("agg16_target_sum", "SELECT gene_idx, round(sum(y_pred), 6) AS value FROM mat WHERE target_idx IN (1, 5, 9) GROUP BY gene_idx", "mat")
def _(spark, d):
    return r6(joins.target_sum(v.mat(spark, d), [1, 5, 9], ["gene_idx"]), "value")


@query("agg17_length_sum", "SELECT seq_id, target_idx, round(sum(y_pred), 6) AS value FROM pos_counts GROUP BY ALL", "pos_counts")
def _(spark, d):
    return r6(matrix.length_sum(v.pos_counts(spark, d), ["seq_id", "target_idx"]), "value")


@query("agg18_position_aggregate", """WITH m AS (SELECT seq_id, pos, avg(y_pred) AS v FROM pos_counts GROUP BY ALL)
SELECT seq_id, 'num' AS role, round(sum(v * (pos + 1) / 8.0) / sum((pos + 1) / 8.0), 6) AS value FROM m WHERE pos < 4 GROUP BY seq_id""", "pos_counts")
def _(spark, d):
    x = v.pos_counts(spark, d).groupBy("seq_id", "pos").agg(F.avg("y_pred").alias("value"))
    where = x.where("pos < 4").select("seq_id", "pos", ((F.col("pos") + 1) / 8).alias("mask"), F.lit("num").alias("role"))
    return r6(matrix.position_aggregate(matrix.slice_positions(x, where), True), "value")


@query("prj9_slice_positions", "SELECT seq_id, target_idx, pos, round(y_pred * (pos + 1) / 8.0, 6) AS value FROM pos_counts WHERE pos < 4", "pos_counts")
def _(spark, d):
    x = v.pos_counts(spark, d).select("seq_id", "pos", "target_idx", F.col("y_pred").alias("value"))
    where = x.where("pos < 4").select("seq_id", "pos", ((F.col("pos") + 1) / 8).alias("mask"), F.lit("num").alias("role")).distinct()
    return r6(matrix.slice_positions(x, where).select("seq_id", "target_idx", "pos", "value"), "value")
