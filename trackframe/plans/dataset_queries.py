"""Queries of matrices, splits, joins, targets and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import dist, ensembles, joins, matrix, splits, targets
from trackframe.plans import views as v
from trackframe.plans.metric_queries import r6
from trackframe.plans.registry import query
from trackframe.sources import readers, writers


def genes(spark, d):
    return v.t(spark, d, "embeddings").select(F.col("vec_id").alias("gene_idx"), F.col("label").alias("chrom"))


@query("agg28_detect_dimensions", "SELECT count(DISTINCT vec_id) AS num_genes, 8 AS num_bins, 8 AS num_tracks, true AS agree FROM embeddings")
def _(spark, d):
    x = readers.detect_dimensions(v.tracks(spark, d))
    return x.select("num_genes", F.col("num_bins").cast("int"), F.col("num_tracks").cast("int"), "agree")


@query("agg26_target_coverage_stats", "SELECT count(DISTINCT gene_idx) AS num_seqs, count(DISTINCT track_idx) FILTER (list_max(list_transform(bins, lambda x: abs(x))) > 0) AS num_targets FROM tracks", "tracks")
def _(spark, d):
    return joins.coverage_stats(v.tracks(spark, d))


@query("prj4_wide_to_long", "SELECT p_partkey, name, value::DOUBLE AS value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR name IN (size, price))")
def _(spark, d):
    p = v.t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return matrix.wide_to_long(p, ["p_partkey"], ["size", "price"], "name")


@query("prj4_array_round_trip", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS s, len(embedding)::INT AS n FROM embeddings")
def _(spark, d):
    long = matrix.array_to_long(v.t(spark, d, "embeddings"), ["vec_id"], "embedding")
    back = matrix.long_to_array(long, ["vec_id"], out="embedding")
    return back.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("s"), F.size("embedding").alias("n"))


@query("prj5_transpose_matrix", "SELECT gene_idx, b::INT AS bin_idx, track_idx, round(bins[b + 1]::DOUBLE, 6) AS value FROM tracks, range(0, 8) r(b)", "tracks")
def _(spark, d):
    packed = matrix.long_to_array(v.tracks(spark, d), ["gene_idx"], "track_idx", "bins", "features")
    turned = packed.select("gene_idx", F.posexplode(matrix.transpose_packed(F.col("features"))).alias("bin_idx", "row"))
    return turned.select("gene_idx", "bin_idx", F.posexplode("row").alias("track_idx", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("prj6_center_crop", "SELECT gene_idx, track_idx, array_to_string(list_transform(bins[3:6], lambda x: round(x::DOUBLE, 4)::DECIMAL(9, 4)), ' ') AS kept FROM tracks", "tracks")
def _(spark, d):
    kept = F.transform(matrix.center_crop(F.col("bins"), 4), lambda x: F.round(x.cast("double"), 4).cast("decimal(9,4)").cast("string"))
    return v.tracks(spark, d).select("gene_idx", "track_idx", F.array_join(kept, " ").alias("kept"))


@query("prj7_step_positions", "SELECT gene_idx, target_idx AS pos, round(y_true, 6) AS value FROM mat WHERE target_idx % 4 = 0", "mat")
def _(spark, d):
    return r6(matrix.step_positions(v.mat(spark, d).select("gene_idx", F.col("target_idx").alias("pos"), F.col("y_true").alias("value")), 4), "value")


@query("prj8_slice_targets", "SELECT gene_idx, CASE target_idx WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS target_idx, round(y_pred, 6) AS y_pred FROM mat WHERE target_idx IN (7, 2, 30)", "mat")
def _(spark, d):
    chosen = spark.createDataFrame([(7, 0), (2, 1), (30, 2)], "target_idx int, out_idx int")
    return r6(matrix.slice_targets(v.mat(spark, d), chosen).select("gene_idx", "target_idx", "y_pred"), "y_pred")


CHROM = "CASE WHEN chrom::VARCHAR = '3' THEN 'test' WHEN chrom::VARCHAR = '4' THEN 'valid' ELSE 'train' END"


@query("prj12_split_by_chromosome", f"SELECT vec_id AS gene_idx, label AS chrom, {CHROM.replace('chrom', 'label')} AS split FROM embeddings")
def _(spark, d):
    return splits.split_by_chromosome(genes(spark, d), "3", "4")


RANDOM = """SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|7'), o_orderkey) AS r, count(*) OVER () AS n FROM orders)"""


@query("prj13_split_random", RANDOM)
def _(spark, d):
    return splits.split_random(v.t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8, 1, 1, 7)


@query("set4_split_partition", f"SELECT 0::BIGINT AS violations, count(*) AS n FROM ({RANDOM})")
def _(spark, d):
    s = splits.split_random(v.t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8, 1, 1, 7)
    return s.agg(F.count("*").alias("n")).crossJoin(F.broadcast(splits.split_violations(s, "o_orderkey").agg(F.count("*").alias("violations"))))


@query("agg27_split_counts", f"SELECT split, count(*) AS n, count(*) // 64 AS batches FROM ({RANDOM}) GROUP BY split")
def _(spark, d):
    return splits.split_counts(splits.split_random(v.t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8, 1, 1, 7), 64)


@query("win5_shard_number", "SELECT o_orderkey, o_orderstatus AS split, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|0'), o_orderkey) - 1) // 64 AS shard FROM orders")
def _(spark, d):
    return splits.shards(v.t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), "o_orderkey", 64)


@query("sort4_shuffle_examples", "SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|5|2'), o_orderkey) AS position FROM orders")
def _(spark, d):
    return splits.shuffle_rank(v.t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, 2)


@query("sort5_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, d):
    return splits.take(v.t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, "o_orderkey")


@query("join1_features_with_labels", "SELECT vec_id AS gene_idx, len(embedding)::INT AS n_features, label::DOUBLE AS y_true FROM embeddings")
def _(spark, d):
    e = v.t(spark, d, "embeddings")
    feats, labels = e.select(F.col("vec_id").alias("gene_idx"), F.size("embedding").alias("n_features")), e.select(F.col("vec_id").alias("gene_idx"), F.col("label").cast("double").alias("y_true"))
    return joins.features_with_labels(feats, labels)


@query("join2_preds_with_targets", "SELECT gene_idx, target_idx, round(y_pred - y_true, 6) AS error FROM mat", "mat")
def _(spark, d):
    m = v.mat(spark, d)
    both = joins.preds_with_targets(m.select("gene_idx", "target_idx", "y_pred"), m.select("gene_idx", "target_idx", "y_true"), ["gene_idx", "target_idx"])
    return r6(both.select("gene_idx", "target_idx", (F.col("y_pred") - F.col("y_true")).alias("error")), "error")


@query("join3_attach_gene_ids", f"SELECT vec_id AS gene_idx, CASE WHEN vec_id % 10 = 0 THEN 'Gene_' || (vec_id + 1) ELSE 'ID' || vec_id END AS GeneID, CASE WHEN vec_id % 10 <> 0 THEN {CHROM.replace('chrom', 'label')} END AS split FROM embeddings")
def _(spark, d):
    g = genes(spark, d)
    ids = splits.split_by_chromosome(g.where("gene_idx % 10 <> 0"), "3", "4").select("gene_idx", F.concat(F.lit("ID"), "gene_idx").alias("id"), "split")
    return joins.attach_gene_ids(g, ids).select("gene_idx", "GeneID", "split")


@query("join6_with_target_info", "SELECT seq_id, target_idx, y_pred, scale, clip_soft, sum_stat FROM target_preds JOIN targets USING (target_idx)", "target_preds targets")
def _(spark, d):
    return targets.with_target_info(v.target_preds(spark, d), v.targets(spark, d)).select("seq_id", "target_idx", "y_pred", "scale", "clip_soft", "sum_stat")


def _undo(name, sql, make):
    @query(name, f"SELECT seq_id, target_idx, round({sql}, 4) AS value FROM target_preds JOIN targets USING (target_idx)", "target_preds targets")
    def _(spark, d):
        x = targets.with_target_info(v.target_preds(spark, d), v.targets(spark, d))
        return x.select("seq_id", "target_idx", F.round(make(F.col("y_pred"), F.col("scale"), F.col("clip_soft"), F.col("sum_stat")), 4).alias("value"))


CLIP = "(CASE WHEN y_pred > clip_soft THEN clip_soft - 1 + (y_pred - clip_soft + 1) ^ 2 ELSE y_pred END)"
_undo("prj17_untransform", f"CASE WHEN contains(sum_stat, '_sqrt') THEN ({CLIP} + 1) ^ 2 - 1 ELSE {CLIP} END / scale", lambda p, s, c, t: targets.untransform(p, s, c, t, True))
OLD = "(CASE WHEN y_pred / scale > clip_soft THEN clip_soft + (y_pred / scale - clip_soft) ^ 2 ELSE y_pred / scale END)"
_undo("prj18_untransform_old", f"CASE WHEN contains(sum_stat, '_sqrt') THEN {OLD} ^ (4 / 3.0) ELSE {OLD} END * scale", lambda p, s, c, t: targets.untransform_old(p, s, c, t))
_undo("prj19_untransform_generic", "((CASE WHEN y_pred > 30 THEN (y_pred - 29) ^ 2 + 29 ELSE y_pred END + 1) ^ (1 / 0.75) - 1) / 2", lambda p, s, c, t: targets.untransform_generic(p, 0.75, 2.0, 30.0))
_undo("prj19_untransform_generic_old", "(CASE WHEN y_pred / 2 > 10 THEN (y_pred / 2 - 10) ^ 2 + 10 ELSE y_pred / 2 END) ^ (1 / 0.75)", lambda p, s, c, t: targets.untransform_generic(p, 0.75, 2.0, 10.0, True))
_undo("prj20_score_transform", "ln((y_pred + 1) / (clip_soft + 1) + 1e-6)", lambda p, s, c, t: targets.score_transform(p, c, 1.0))
_undo("prj20_score_log_odds", "CASE WHEN y_pred < 60 THEN ln((y_pred / 60) / (1 - y_pred / 60) + 1e-6) END", lambda p, s, c, t: targets.score_transform(p, F.lit(60.0), 0.0, True))
_undo("prj22_threshold_and_clip", "CASE WHEN y_pred < 20 THEN 0 ELSE least(greatest(y_pred, 0), 45) END", lambda p, s, c, t: matrix.clip(matrix.floor_below(p, 20.0), 45.0))
_undo("prj25_downcast", "(y_pred / 7)::FLOAT::DOUBLE", lambda p, s, c, t: (p / 7).cast("float").cast("double"))


@query("prj25_downcast_columns", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / 7)::FLOAT::DOUBLE)), 5) AS total, (label / 7)::FLOAT::DOUBLE AS label FROM embeddings")
def _(spark, d):
    e = v.t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / 7).alias("embedding"), (F.col("label") / 7).alias("label"))
    small = matrix.downcast(e, "embedding", "label")
    return small.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), F.col("label").cast("double").alias("label"))


GROUPS = "SELECT *, coalesce(sum(CASE WHEN strand_pair = target_idx OR identifier LIKE '%-' THEN 1 ELSE 0 END) OVER (ORDER BY target_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS group_id FROM targets"


@query("win6_strand_group_id", f"SELECT target_idx, group_id FROM ({GROUPS})", "targets")
def _(spark, d):
    return targets.strand_groups(v.targets(spark, d)).select("target_idx", "group_id")


@query("agg20_merge_strand_pairs", f"SELECT seq_id, group_id, round(sum(y_pred), 6) AS y_pred FROM target_preds JOIN ({GROUPS}) g USING (target_idx) GROUP BY ALL", "target_preds targets")
def _(spark, d):
    return r6(targets.merge_strand_pairs(v.target_preds(spark, d), v.targets(spark, d), ["seq_id"]), "y_pred")


@query("agg21_collapse_strand_targets", "SELECT target_idx, identifier, strand FROM (SELECT *, CASE WHEN strand_pair = target_idx THEN '.' ELSE right(identifier, 1) END AS strand FROM targets) WHERE strand <> '-'", "targets")
def _(spark, d):
    return targets.collapse_strand_targets(v.targets(spark, d)).select("target_idx", "identifier", "strand")


@query("join7_swap_strand_pairs", "SELECT seq_id, CASE WHEN seq_id % 2 = 0 THEN 7 - target_idx % 8 ELSE target_idx % 8 END AS pos, CASE WHEN seq_id % 2 = 0 THEN strand_pair ELSE target_idx END AS target_idx, y_pred FROM target_preds JOIN targets USING (target_idx)", "target_preds targets")
def _(spark, d):
    x = v.target_preds(spark, d).withColumn("is_rc", F.col("seq_id") % 2 == 0).withColumn("pos", F.col("target_idx") % 8)
    return targets.swap_strand_pairs(x, v.targets(spark, d), 8).select("seq_id", "pos", "target_idx", "y_pred")


@query("prj24_position_feature", "SELECT gene_idx, target_idx, (target_idx - 16)::DOUBLE AS plain, (abs(target_idx - 16) ^ 2)::DOUBLE AS squared, (15 - target_idx)::DOUBLE AS reversed FROM mat", "mat")
def _(spark, d):
    p, n = F.col("target_idx"), F.lit(32)
    return v.mat(spark, d).select("gene_idx", "target_idx", matrix.position_feature(p, n).alias("plain"), matrix.position_feature(p, n, "abs", 2.0).alias("squared"), matrix.position_feature(p, n, "reversed").alias("reversed"))


# ---- ensembles --------------------------------------------------------------------------------------
@query("agg13_seed_mean_std", "SELECT gene_id, target_idx, round(avg(y_pred), 6) AS mean, round(stddev_pop(y_pred), 6) AS std FROM seed_preds GROUP BY ALL", "seed_preds")
def _(spark, d):
    return r6(ensembles.seed_mean_std(v.seed_preds(spark, d)), "mean", "std")


@query("agg14_seed_sample_std", "SELECT gene_id, target_idx, round(stddev_samp(y_pred), 6) AS std FROM seed_preds GROUP BY ALL", "seed_preds")
def _(spark, d):
    return r6(ensembles.seed_sample_std(v.seed_preds(spark, d)), "std")


@query("agg15_seed_box_stats", """WITH q AS (SELECT target_idx, quantile_cont(y_pred, 0.25) AS q1, quantile_cont(y_pred, 0.5) AS median, quantile_cont(y_pred, 0.75) AS q3, avg(y_pred) AS mean FROM seed_preds GROUP BY target_idx)
SELECT target_idx, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(mean), 6) AS mean, round(min(y_pred), 6) AS low, round(max(y_pred), 6) AS high
FROM seed_preds JOIN q USING (target_idx) WHERE y_pred BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY target_idx""", "seed_preds")
def _(spark, d):
    return r6(ensembles.seed_box_stats(v.seed_preds(spark, d), ["target_idx"]), "q1", "median", "q3", "mean", "low", "high")


@query("agg19_ensemble_average", "SELECT gene_id, round(avg(y_pred), 6) AS y_pred FROM seed_preds GROUP BY ALL", "seed_preds")
def _(spark, d):
    return r6(ensembles.ensemble_average(v.seed_preds(spark, d), ["gene_id"]), "y_pred")


PIVOT = "SELECT gene_id, " + ", ".join(f"round(avg(y_pred) FILTER (target_idx = {k}), 6) AS target_{k}_mean, round(stddev_pop(y_pred) FILTER (target_idx = {k}), 6) AS target_{k}_std" for k in range(1, 8)) + ", " + ", ".join(f"round(max(y_pred) FILTER (target_idx = {k} AND seed = {m}), 6) AS target_{k}_seed_{m}" for k in range(1, 8) for m in range(5)) + " FROM seed_preds GROUP BY gene_id"


@query("agg30_pivot_predictions", PIVOT, "seed_preds")
def _(spark, d):
    p = ensembles.pivot_predictions(v.seed_preds(spark, d), list(range(1, 8)), list(range(5)))
    return r6(p, *p.columns[1:])


@query("snk7_write_wide_predictions", PIVOT.replace("SELECT gene_id", "SELECT gene_id AS geneID"), "seed_preds")
def _(spark, d):
    p = writers.arrange_predictions(ensembles.pivot_predictions(v.seed_preds(spark, d), list(range(1, 8)), list(range(5))))
    return r6(p, *p.columns[1:])


@query("prj14_arrange_columns", "SELECT l_partkey AS geneID, max(l_quantity) AS target_2_mean, min(l_quantity) AS target_10_mean FROM lineitem GROUP BY ALL")
def _(spark, d):
    x = v.t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("geneID")).agg(F.min("l_quantity").alias("target_10_mean"), F.max("l_quantity").alias("target_2_mean"))
    return x.select("geneID", *writers.natural_columns([c for c in x.columns if c != "geneID"]))


@query("join12_score_models", "SELECT gene_idx AS row_idx, m::INT AS model, round(sum(y_true * (target_idx % (m + 2))), 6) AS y_pred FROM mat, range(0, 3) r(m) GROUP BY ALL", "mat")
def _(spark, d):
    m = v.mat(spark, d)
    w = m.select(F.col("target_idx").alias("feature")).distinct().withColumn("model", F.explode(F.expr("sequence(0, 2)"))).withColumn("w", (F.col("feature") % (F.col("model") + 2)).cast("double"))
    return r6(ensembles.score_linear(m.select(F.col("gene_idx").alias("row_idx"), F.col("target_idx").alias("feature"), F.col("y_true").alias("x")), w), "y_pred")


@query("udf1_score_batches", "SELECT vec_id, 'mean' AS model, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS y_pred FROM embeddings")
def _(spark, d):
    s = ensembles.score_batches(v.t(spark, d, "embeddings"), {"mean": lambda x: x.mean(1)}, "vec_id", "embedding")
    return s.select("vec_id", "model", F.round(F.col("y_pred")[0], 5).alias("y_pred"))


# ---- names ------------------------------------------------------------------------------------------
NATURAL = "SELECT DISTINCT p_size || '.h5' AS name, (dense_rank() OVER (ORDER BY p_size) - 1)::INT AS idx FROM part"


@query("win3_natural_index", NATURAL)
def _(spark, d):
    return dist.natural_index(v.t(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(".h5")).alias("name")), "name")


@query("sort3_natural_sort", NATURAL)
def _(spark, d):
    names = v.t(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(".h5")).alias("name")).distinct()
    return dist.natural_index(names.orderBy(*dist.natural_key(F.col("name"))), "name")


@query("set2_distinct_names", "SELECT DISTINCT p_brand AS description FROM part")
def _(spark, d):
    return joins.distinct_names(v.targets(spark, d), "description")


@query("dist_rank_within", "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|3'), o_orderkey) AS rank FROM orders")
def _(spark, d):
    return dist.rank_within(v.t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 3)
