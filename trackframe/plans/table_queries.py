"""Queries of experiments, readers, writers and streams.

Writers write to the shared folder and the query reads back what they wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackframe.operators import experiments as ex
from trackframe.operators import metrics
from trackframe.plans import views as v
from trackframe.plans.metric_queries import R2, SUMS, R, r6
from trackframe.plans.registry import query
from trackframe.sources import readers, writers
from trackframe.streaming import streams


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share; one of this machine only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("the session names no shared folder in spark.checkpoint.dir")
        at = "file:///tmp/trackframe-shared"
    # One folder a session, which goes with it.
    own = f"{at.rstrip('/')}/trackframe/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def drained(stream, spark, mode: str, schema: str, key: list[str] | None = None, out: str | None = None, progress: str | None = None):
    """What a stream over finished input wrote, batch by batch; with `key`, its last row of each. A stream that is taken up again names its folders."""
    out = out or scratch(spark, "stream")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch_={number}")  # a batch that is tried again replaces its own rows

    stream.writeStream.outputMode(mode).option("checkpointLocation", progress or scratch(spark, "progress")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    got = spark.read.schema(f"{schema}, batch_ long").parquet(out)
    if key:
        rest = [c for c in got.columns if c not in (*key, "batch_")]
        got = got.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_").alias("e")).select(*key, "e.*")
    return got.drop("batch_")


# ---- epochs and experiments ----------------------------------------------------------------------------
SCORED = """WITH s AS (SELECT *, valid_r + valid_r2 / 4 AS score FROM epochs),
b AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM s),
u AS (SELECT *, (epoch - max(CASE WHEN best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch))::INT AS unimproved FROM b),
t AS (SELECT *, epoch >= 4 AND unimproved > 2 AS stop FROM u)
"""


@query("win2_early_stopping_trace", SCORED + "SELECT run, epoch, round(score, 8) AS score, best, unimproved, stop FROM t", "epochs")
def _(spark, d):
    return ex.early_stopping_trace(v.epochs(spark, d), 4, 2).select("run", "epoch", F.round("score", 8).alias("score"), "best", "unimproved", "stop")


@query("win2_first_stop", SCORED + "SELECT run, min(epoch) AS stop_epoch FROM t WHERE stop GROUP BY run", "epochs")
def _(spark, d):
    return ex.first_stop(ex.early_stopping_trace(v.epochs(spark, d), 4, 2))


@query("win2b_early_stopping_callback", """WITH b AS (SELECT *, coalesce(valid_r < min(valid_r) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM epochs),
u AS (SELECT *, epoch - max(CASE WHEN best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS unimproved FROM b) SELECT run, min(epoch) AS stop_epoch FROM u WHERE epoch >= 3 AND unimproved >= 2 GROUP BY run""", "epochs")
def _(spark, d):
    return ex.first_stop(ex.early_stopping_trace(v.epochs(spark, d), 3, 2, F.col("valid_r"), "min", True))


@query("win1_last_best_epoch", SCORED + "SELECT run, max(epoch) AS epoch, round(arg_max(valid_r, epoch), 6) AS valid_r FROM t WHERE best GROUP BY run", "epochs")
def _(spark, d):
    best = ex.early_stopping_trace(v.epochs(spark, d), 4, 2).select("run", "epoch", "valid_r", "best")
    return r6(ex.last_best_epoch(best), "valid_r")




def _lines(spark, d):
    e = v.epochs(spark, d)
    text = lambda c: F.format_string("%.4f", c)
    line = F.concat(F.lit("Epoch "), F.col("epoch").cast("string"), F.lit(" - "), (F.col("epoch") % 60).cast("string"), F.lit("s - train_loss: "), text(F.col("valid_r")), F.lit(" - train_r: -0.0007 - train_r2: 0.1 - valid_loss: 0.5 - valid_r: -"), (F.col("epoch") % 7).cast("string"), F.lit(".5 - valid_r2: 1e-4"), F.when(F.col("epoch") % 3 == 0, " best!").otherwise(""))
    return e.select(line.alias("value"), F.concat(F.lit("r"), F.col("run").cast("string")).alias("run"))


EPOCH_ROWS = "SELECT 'r' || run AS run, epoch, (epoch % 60)::INT AS secs, -0.0007::DOUBLE AS train_r, -(epoch % 7 + 0.5)::DOUBLE AS valid_r, 1e-4::DOUBLE AS valid_r2, epoch % 3 = 0 AS best FROM epochs"
EPOCH_COLS = ["run", "epoch", "secs", "train_r", "valid_r", "valid_r2", "best"]


@query("src8_scan_epoch_logs", EPOCH_ROWS.replace("'r' || run AS run", "'r' || run % 16 AS run"), "epochs")
def _(spark, d):
    """Sixteen log files hold the lines of all runs; a row's run is its file's name."""
    at = scratch(spark, "logs")
    lines = _lines(spark, d).withColumn("run", F.concat(F.lit("r"), (F.substring("run", 2, 20).cast("long") % 16).cast("string")))
    lines.repartition("run").write.partitionBy("run").text(at)
    return readers.scan_epoch_logs(spark, at).select(*EPOCH_COLS)


@query("src8_parse_epoch_lines", EPOCH_ROWS, "epochs")
def _(spark, d):
    return ex.parse_epoch_lines(_lines(spark, d)).select(*EPOCH_COLS)


GRID = "SELECT DISTINCT p_brand AS path, '8, 15, x, 1.5, 1e-4, ' || length(p_brand) AS text FROM part"


@query("prj15_parse_param_grid", f"SELECT path, i::INT AS place, x AS value, CASE WHEN regexp_matches(x, '^-?[0-9]+$') THEN 'int' WHEN regexp_matches(x, '^-?[0-9]+\\.[0-9]+$') THEN 'double' ELSE 'string' END AS kind FROM (SELECT path, i, trim(string_split(text, ',')[i + 1]) AS x FROM ({GRID}), range(0, 6) r(i))")
def _(spark, d):
    g = v.t(spark, d, "part").select(F.col("p_brand").alias("path"), F.concat(F.lit("8, 15, x, 1.5, 1e-4, "), F.length("p_brand").cast("string")).alias("text")).distinct()
    return ex.parse_param_grid(g)


def _grid(spark, d):
    """Kernel sizes are the part sizes, layers the return flags, a third list the line statuses."""
    from pyspark.sql import Window

    p = v.t(spark, d, "part").select(F.lit("kernel").alias("path"), F.col("p_size").cast("string").alias("value")).distinct()
    li = v.t(spark, d, "lineitem")
    p = p.union(li.select(F.lit("layer"), "l_returnflag").distinct()).union(li.select(F.lit("head"), "l_linestatus").distinct())
    return p.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("value")) - 1)


GRID_ROWS = """WITH k AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT p_size::VARCHAR AS value FROM part)),
l AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT l_returnflag AS value FROM lineitem)), h AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT l_linestatus AS value FROM lineitem)),
g AS (SELECT 'exp_' || ((k.i * (SELECT count(*) FROM l) + l.i) * (SELECT count(*) FROM h) + h.i) || '_seed_' || s AS exp_name, s::INT AS seed, k.value AS kernel, l.value AS layer, h.value AS head FROM k, l, h, (VALUES (0), (1), (2)) x(s))
"""


def _experiments(spark, d):
    return ex.grid_product(_grid(spark, d), ["kernel", "layer", "head"], [0, 1, 2])


@query("join9_grid_product", GRID_ROWS + "SELECT * FROM g")
def _(spark, d):
    return _experiments(spark, d)


@query("join10_pending_experiments", GRID_ROWS + "SELECT exp_name, seed FROM g WHERE NOT (seed = 1 AND layer = 'A')")
def _(spark, d):
    g = _experiments(spark, d)
    log = g.select("exp_name", F.when((F.col("seed") == 1) & (F.col("layer") == "A"), "success").otherwise("failed").alias("status"))
    return ex.pending_experiments(g, log).select("exp_name", "seed")


@query("join11_experiments_with_config", GRID_ROWS + "SELECT exp_name, kernel, seed * 0.5::DOUBLE AS valid_r FROM g WHERE seed < 2")
def _(spark, d):
    g = _experiments(spark, d)
    return ex.experiments_with_config(g.where("seed < 2").select("exp_name", (F.col("seed") * F.lit(0.5)).alias("valid_r")), g.select("exp_name", "kernel")).select("exp_name", "kernel", "valid_r")


@query("prj16_override_params", GRID_ROWS + "SELECT exp_name, path, CASE path WHEN 'model.kernel' THEN kernel WHEN 'train.seed' THEN seed::VARCHAR ELSE base END AS value FROM g, (VALUES ('model.kernel', '9'), ('train.seed', '0'), ('train.rate', '1e-4')) b(path, base)")
def _(spark, d):
    g = _experiments(spark, d)
    own = g.select("exp_name", F.lit("model.kernel").alias("path"), F.col("kernel").alias("value")).union(g.select("exp_name", F.lit("train.seed"), F.col("seed").cast("string")))
    base = spark.createDataFrame([("model.kernel", "9"), ("train.seed", "0"), ("train.rate", "1e-4")], "path string, value string")
    return ex.override_params(own, base)


@query("set3_merge_experiment_log", "SELECT 'u' || user_id AS exp_name, max(event_id) AS entry, arg_max(event_type, event_id) AS status FROM events GROUP BY ALL")
def _(spark, d):
    e = v.t(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("exp_name"), F.col("event_id").alias("entry"), F.col("event_type").alias("status"))
    return ex.merge_experiment_log(e.where("entry % 2 = 0"), e.where("entry % 2 = 1"), "entry")


REPORT = "SELECT 'e' || run % 50 AS base, round(avg(r), 6) AS valid_r_mean, round(stddev_pop(r), 6) AS valid_r_std, " + ", ".join(f"round(max(r) FILTER (seed = {s}), 6) AS valid_r_seed_{s}" for s in range(3)) + " FROM (SELECT run, run // 50 % 3 AS seed, max(valid_r) AS r FROM epochs GROUP BY run) GROUP BY 1"


def _report(spark, d):
    x = v.epochs(spark, d).groupBy("run").agg(F.max("valid_r").alias("valid_r"))
    return ex.seed_report(x.select(F.concat(F.lit("e"), (F.col("run") % 50).cast("string")).alias("base"), (F.floor(F.col("run") / 50) % 3).alias("seed"), "valid_r"), [0, 1, 2])


@query("agg29_seed_report", REPORT, "epochs")
def _(spark, d):
    x = _report(spark, d)
    return r6(x, *x.columns[1:])


@query("sort1_rank_experiments", f"SELECT base, valid_r_mean FROM ({REPORT}) ORDER BY valid_r_mean DESC, base", "epochs")
def _(spark, d):
    x = _report(spark, d)
    return ex.rank_experiments(r6(x, "valid_r_mean")).select("base", "valid_r_mean")


@query("snk8_write_experiment_report", f"SELECT base AS experiment, valid_r_mean, valid_r_std, 'k' AS grid_kernel FROM ({REPORT})", "epochs")
def _(spark, d):
    x = r6(_report(spark, d), "valid_r_mean", "valid_r_std").select(F.lit("k").alias("grid_kernel"), "valid_r_std", "valid_r_mean", F.col("base").alias("experiment"))
    at = scratch(spark, "report")
    writers.write_experiment_report(x, at, ["valid_r_mean", "valid_r_std"])
    return spark.read.csv(at, header=True, schema="experiment string, valid_r_mean double, valid_r_std double, grid_kernel string")


# ---- readers and writers ---------------------------------------------------------------------------------
@query("src1_scan_tracks", "SELECT track_idx, gene_idx, round(list_sum(list_transform(bins, lambda x: x::DOUBLE)), 5) AS total FROM tracks", "tracks")
def _(spark, d):
    at = scratch(spark, "tracks")
    v.tracks(spark, d).withColumn("file", F.concat(F.lit("h5_"), F.col("track_idx").cast("string"))).drop("track_idx").repartition("file").write.partitionBy("file").parquet(at)
    got = readers.scan_tracks(spark, at)
    return got.select("track_idx", "gene_idx", F.round(F.aggregate("bins", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


SHEET = ["p_name", "p_brand", "p_type"]


@query("src2_scan_expression_sheet", "SELECT p_partkey AS gene_idx, i::INT AS target_idx, CASE i WHEN 0 THEN 'p_size' ELSE 'p_retailprice' END AS target_name, CASE i WHEN 0 THEN p_size ELSE p_retailprice END::DOUBLE AS y_true, p_brand FROM part, range(0, 2) r(i)")
def _(spark, d):
    p = v.t(spark, d, "part")
    sheet = p.select("p_partkey", *SHEET, F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    at = scratch(spark, "sheet")
    writers.write_tsv(sheet, at)
    meta, labels = readers.scan_expression_sheet(spark, at, "p_partkey", 3)
    return labels.join(meta.select("gene_idx", "p_brand"), "gene_idx").select("gene_idx", "target_idx", "target_name", "y_true", "p_brand")


@query("src3_extract_label_columns", "SELECT p_size, p_retailprice FROM part")
def _(spark, d):
    at = scratch(spark, "labels")
    writers.write_tsv(readers.extract_label_columns(v.t(spark, d, "part").select("p_partkey", *SHEET, "p_size", "p_retailprice"), 4), at)
    return readers.scan_tsv(spark, at, "p_size int, p_retailprice double")


@query("src4_scan_targets", "SELECT o_orderkey AS gene_idx, o_orderstatus AS split FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    at = scratch(spark, "targets")
    writers.write_tsv(v.t(spark, d, "orders").select(F.col("o_orderkey").alias("gene_idx"), F.col("o_orderstatus").alias("split")), at)
    return readers.scan_targets(spark, at, "gene_idx long, split string", "F")


@query("src5a_scan_bed", 'SELECT chrom, "start", "end", CASE WHEN row_id % 2 = 0 THEN strand ELSE \'+\' END AS strand FROM bed', "bed")
def _(spark, d):
    at = scratch(spark, "bed")
    b = v.bed(spark, d)
    short = F.concat_ws("  ", "chrom", F.concat(F.col("start").cast("string"), F.lit(".0")), F.col("end").cast("string"))
    b.select(F.when(F.col("row_id") % 2 == 0, F.concat_ws("\t", short, F.lit("n"), F.lit("0"), "strand")).otherwise(short).alias("value")).write.text(at)
    return readers.scan_bed(spark, at)


@query("src5b_scan_sequences_bed", 'SELECT chrom, "start", "end", strand AS split FROM bed WHERE strand = \'+\'', "bed")
def _(spark, d):
    at = scratch(spark, "sequences")
    b = v.bed(spark, d).select("chrom", "start", "end", F.col("strand").alias("split"))
    b.write.csv(at, sep="\t")
    return readers.scan_sequences_bed(spark, at, "+", b.where("split = '+'").count())


@query("src6_scan_gff3", """SELECT chrom, "start", "end", strand, feature, 'g' || "start" AS gene_name FROM ann WHERE feature IN ('A', 'R')""", "ann")
def _(spark, d):
    at = scratch(spark, "gff")
    a = v.ann(spark, d)
    a.select("chrom", F.lit("src"), "feature", F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=x;gene_name=g"), F.col("start").cast("string"))).write.csv(at, sep="\t")
    return readers.scan_gff3(spark, at, ["A", "R"])


SHARDS = "SELECT o_orderkey AS gene_idx, o_orderstatus AS split, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|0'), o_orderkey) - 1) // 64) AS shard FROM orders"


def _shards(spark, d):
    at = scratch(spark, "shards")
    writers.write_split_shards(v.t(spark, d, "orders").select(F.col("o_orderkey").alias("gene_idx"), F.col("o_orderstatus").alias("split"), "o_totalprice"), at)
    return at


@query("snk1_write_split_shards", SHARDS)
def _(spark, d):
    return readers.scan_shards(spark, _shards(spark, d), None, ["gene_idx", "split", "shard"])


@query("snk1_write_feature_shards", """SELECT vec_id AS gene_idx, label % 3 = 0 AS held_out, b::INT AS bin, t::INT AS track, embedding[8 * t + b + 1] AS value, embedding[61 + b % 4]::DOUBLE AS target FROM embeddings, range(0, 8) r(t), range(0, 8) s(b)""")
def _(spark, d):
    """Eight tracks of eight bins and four targets a gene, written and read as matrices [bins][tracks]."""
    e, at = v.t(spark, d, "embeddings"), scratch(spark, "features")
    labels = e.select(F.col("vec_id").alias("gene_idx"), F.posexplode(F.slice("embedding", 61, 4)).alias("target_idx", "y_true"))
    writers.write_feature_shards(v.tracks(spark, d), labels, e.select(F.col("vec_id").alias("gene_idx"), F.when(F.col("label") % 3 == 0, "test").otherwise("train").alias("split")), at)
    rows = readers.scan_feature_shards(spark, at).select("gene_idx", (F.col("split") == "test").alias("held_out"), "targets", F.posexplode("features").alias("bin", "row"))
    return rows.select("gene_idx", "held_out", "bin", F.get("targets", F.col("bin") % 4).cast("double").alias("target"), F.posexplode("row").alias("track", "value"))


@query("src9_scan_shards", f"SELECT gene_idx, o_totalprice FROM ({SHARDS}) s JOIN orders ON gene_idx = o_orderkey WHERE split = 'F'")
def _(spark, d):
    return readers.scan_shards(spark, _shards(spark, d), "F", ["gene_idx", "o_totalprice"])


@query("src10_scan_keyed_matrix", "SELECT 'g' || l_partkey AS id, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM (SELECT l_partkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    x = v.t(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    m = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), F.encode(F.concat(F.lit("g"), F.col("l_partkey").cast("string")), "UTF-8").alias("id"), F.array("q").alias("features"))
    at = scratch(spark, "matrix")
    m.write.parquet(at)
    return readers.scan_keyed_matrix(spark, at).select("id", F.col("features")[0].alias("q"))


@query("src11_scan_prediction_table", "SELECT gene_id, 'tissue_' || target_idx AS tissue, round(avg(y_pred), 6) AS y_pred FROM seed_preds GROUP BY ALL", "seed_preds")
def _(spark, d):
    s = v.seed_preds(spark, d)
    wide = s.groupBy(F.col("gene_id").alias("geneID"), "seed").agg(*(F.max(F.when(F.col("target_idx") == k, F.col("y_pred"))).alias(f"tissue_{k}") for k in range(1, 8)))
    at = scratch(spark, "wide")
    writers.write_tsv(wide.drop("seed"), at)
    long = readers.prediction_table(readers.scan_tsv(spark, at, "geneID string, " + ", ".join(f"tissue_{k} double" for k in range(1, 8))))
    return r6(long.where("y_pred is not null").groupBy("gene_id", "tissue").agg(F.avg("y_pred").alias("y_pred")), "y_pred")


@query("src12_profile_table", "SELECT 'vec_id' AS \"column\", count(*) AS rows, count(vec_id) AS non_null, min(length(vec_id::VARCHAR)) AS min_size, max(length(vec_id::VARCHAR)) AS max_size, true AS id_like FROM embeddings UNION ALL SELECT 'embedding', count(*), count(embedding), min(len(embedding)), max(len(embedding)), false FROM embeddings UNION ALL SELECT 'label', count(*), count(label), min(length(label::VARCHAR)), max(length(label::VARCHAR)), false FROM embeddings")
def _(spark, d):
    return readers.profile_table(v.t(spark, d, "embeddings")).drop("kind")


@query("src12_first_values", "SELECT 'vec_id' AS \"column\", string_agg(vec_id, ', ' ORDER BY vec_id) AS first FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 5) UNION ALL SELECT 'label', string_agg(label, ', ' ORDER BY vec_id) FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 5)")
def _(spark, d):
    return readers.first_values(v.t(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


@query("src12_first_files", "SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def _(spark, d):
    """All files of a folder that was written in several."""
    at = scratch(spark, "files")
    v.t(spark, d, "orders").select("o_orderkey").repartition(3).write.parquet(at)
    return readers.first_files(spark, at, 3).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("snk2_write_targets_table", "SELECT o_orderkey AS gene_idx, o_orderpriority, o_orderstatus AS split FROM orders")
def _(spark, d):
    o = v.t(spark, d, "orders")
    at = scratch(spark, "table")
    writers.write_targets_table(o.select(F.col("o_orderkey").alias("gene_idx"), "o_orderpriority"), o.select(F.col("o_orderkey").alias("gene_idx"), F.col("o_orderstatus").alias("split")), at)
    return readers.scan_tsv(spark, at, "gene_idx long, o_orderpriority string, split string")


@query("snk3_write_statistics", "SELECT count(*) AS num_genes, count(*) FILTER (label NOT IN (3, 4)) AS train_seqs, count(*) FILTER (label = 4) AS valid_seqs, count(*) FILTER (label = 3) AS test_seqs, 8::BIGINT AS num_bins, 'chromosome' AS split_method, 'a,b' AS target_names, 0.8::DOUBLE AS train_ratio, 0.1::DOUBLE AS valid_ratio, 0.1::DOUBLE AS test_ratio, '3' AS test_chrom, '4' AS valid_chrom FROM embeddings")
def _(spark, d):
    from trackframe.operators.splits import split_by_chromosome

    g = v.t(spark, d, "embeddings").select(F.col("vec_id").alias("gene_idx"), F.col("label").alias("chrom"))
    at = scratch(spark, "facts")
    writers.write_statistics(writers.statistics(split_by_chromosome(g, "3", "4"), 8, 8, ["a", "b"], "chromosome", (0.8, 0.1, 0.1), ("3", "4")), at)
    got = spark.read.schema("num_genes long, train_seqs long, valid_seqs long, test_seqs long, num_bins long, split_method string, target_names array<string>, train_ratio double, valid_ratio double, test_ratio double, test_chrom string, valid_chrom string").json(at)
    return got.withColumn("target_names", F.array_join("target_names", ","))


@query("snk4_write_bedgraph", 'SELECT \'preds\' AS kind, k::INT AS target_idx, chrom, "start" + b * 128 AS "start", "start" + (b + 1) * 128 AS "end", printf(\'%.2f\', (row_id % 1000 / 4.0 + k)::DOUBLE) AS value FROM bed, range(0, 2) r(b), range(0, 2) s(k)', "bed")
def _(spark, d):
    x = v.bed(spark, d).withColumn("bin_idx", F.explode(F.expr("sequence(0, 1)"))).withColumn("target_idx", F.explode(F.expr("sequence(0, 1)")))
    at = scratch(spark, "graph")
    writers.write_bedgraph(x.select(F.lit("preds").alias("kind"), "chrom", "start", "bin_idx", "target_idx", (F.col("row_id") % 1000 / 4 + F.col("target_idx")).alias("value")), at, 128)
    got = spark.read.csv(at, sep="\t", schema="chrom string, start long, end long, value string, kind string, target_idx int")
    return got.select("kind", "target_idx", "chrom", "start", "end", "value")


@query("snk5_write_metric_table", f"SELECT target, n, printf('%.5f', round({R}, 5)) AS pearsonr, printf('%.5f', round({R2}, 5)) AS r2 FROM ({SUMS.format(k='target', t='obs')})", "obs")
def _(spark, d):
    at = scratch(spark, "metrics")
    writers.write_metric_table(metrics.by_target(v.obs(spark, d), ["target"]), at, ["target"])
    return readers.scan_tsv(spark, at, "target string, n long, pearsonr string, r2 string")


@query("snk6_write_prediction_matrix", "SELECT gene_idx, round(sum(y_pred), 5) AS p, round(sum(y_true), 5) AS t FROM mat GROUP BY gene_idx", "mat")
def _(spark, d):
    at = scratch(spark, "matrix")
    writers.write_prediction_matrix(v.mat(spark, d).select("gene_idx", "target_idx", "y_pred", "y_true"), at)
    return spark.read.schema("gene_idx long, target_idx int, y_pred double, y_true double").parquet(at).groupBy("gene_idx").agg(F.round(F.sum("y_pred"), 5).alias("p"), F.round(F.sum("y_true"), 5).alias("t"))


@query("seq15_format_fixed", "SELECT DISTINCT l_discount, printf('%.2f', round(l_discount * 1.5, 2)) AS two, printf('%.5f', round(l_discount / 7, 5)) AS five FROM lineitem")
def _(spark, d):
    return v.t(spark, d, "lineitem").select("l_discount").distinct().select("l_discount", writers.fixed(F.col("l_discount") * 1.5, 2).alias("two"), writers.fixed(F.col("l_discount") / 7, 5).alias("five"))


# ---- streams ---------------------------------------------------------------------------------------------
def _stream(spark, d, table: str):
    at, files = _folder(spark, d, table)
    return spark.readStream.schema(v.t(spark, d, table).schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", -(-files // 4)).parquet(at)


#: Rows of a file that a stream finds, at most.
FILE_ROWS = 2_000_000


def _folder(spark, d, table: str) -> tuple[str, int]:
    """The table as a folder of several files, as a stream would find them, and how many; four or more, none of more than FILE_ROWS rows."""
    at, rows = scratch(spark, f"files-{table}"), v.t(spark, d, table)
    rows.repartition(max(4, -(-rows.count() // FILE_ROWS))).write.parquet(at)
    return at, len(spark.read.parquet(at).inputFiles())


@query("str1_stream_metrics", f"SELECT target, n, round({R}, 6) AS pearsonr, round({R2}, 6) AS r2 FROM ({SUMS.format(k='target', t='obs')})", "obs")
def _(spark, d):
    li = _stream(spark, d, "lineitem")
    obs = li.select(F.concat("l_returnflag", "l_linestatus").alias("target"), F.col("l_quantity").alias("y_true"), (F.col("l_extendedprice") / 2000).alias("y_pred"))
    got = drained(streams.stream_metrics(obs, ["target"]), spark, "update", "target string, n long, pearsonr double, r2 double", ["target"])
    return r6(got, "pearsonr", "r2")


@query("str1_stream_metrics_by_epoch", f"SELECT epoch, target, n, round({R}, 6) AS pearsonr, round({R2}, 6) AS r2 FROM ({SUMS.format(k='epoch, target', t='(SELECT l_linenumber AS epoch, l_returnflag AS target, l_quantity AS y_true, l_extendedprice / 2000 AS y_pred FROM lineitem)')})")
def _(spark, d):
    """Seven epochs arrive one after the other, the last rows of each together with the first of the next but one.

    What arrives together is one batch of as many files as its reading had tasks: the stream is taken up again, from its checkpoint, after each arrival.
    """
    at, out, progress, e = scratch(spark, "epochs"), scratch(spark, "stream"), scratch(spark, "progress"), "l_linenumber"
    for k in range(1, 10):
        v.t(spark, d, "lineitem").where(f"({e} = {k} and l_orderkey % 3 > 0) or ({e} = {k - 2} and l_orderkey % 3 = 0)").select("l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice").write.mode("append").parquet(at)
        li = spark.readStream.schema("l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double").parquet(at)
        obs = li.select(F.col(e).cast("long").alias("epoch"), F.col("l_returnflag").alias("target"), F.col("l_quantity").alias("y_true"), (F.col("l_extendedprice") / 2000).alias("y_pred"))
        got = drained(streams.stream_metrics_by_epoch(obs, ["target"], keep=2), spark, "update", "epoch long, target string, n long, pearsonr double, r2 double", ["epoch", "target"], out, progress)
    return r6(got, "pearsonr", "r2")


@query("str2_stream_scoring", "SELECT vec_id, 'sum' AS model, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS y_pred FROM embeddings")
def _(spark, d):
    got = drained(streams.stream_scoring(_stream(spark, d, "embeddings"), {"sum": lambda x: x.sum(1)}, "vec_id", "embedding"), spark, "append", "vec_id long, model string, y_pred array<double>")
    return got.select("vec_id", "model", F.round(F.col("y_pred")[0], 4).alias("y_pred"))


TRACE = "run long, epoch int, score double, best boolean, unimproved int, stop boolean, late boolean"


def _early_stop(spark, d, parts: tuple[str, ...]):
    """The trace of epochs whose files arrive part by part; the runs' states are carried from one to the next."""
    at, n = scratch(spark, "epochs"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = scratch(spark, "runs")
    v.epochs(spark, d).write.parquet(runs)  # numbered once, not for every part
    for part in parts:
        spark.read.schema("run long, epoch int, valid_r double, valid_r2 double").parquet(runs).where(part).repartition(n, "run").sortWithinPartitions("run", "epoch").write.mode("append").parquet(at)
    stream = spark.readStream.schema("run long, epoch int, valid_r double, valid_r2 double").option("maxFilesPerTrigger", n).parquet(at)
    return drained(streams.stream_early_stop(stream, 4, 2), spark, "append", TRACE).withColumn("score", F.round("score", 8))


@query("str3_stream_early_stop", SCORED + "SELECT run, epoch, round(score, 8) AS score, best, unimproved, stop FROM t", "epochs")
def _(spark, d):
    return _early_stop(spark, d, ("epoch < 4", "epoch between 4 and 9", "epoch > 9")).where("not late").drop("late")


@query("str3_stream_out_of_order", SCORED + "SELECT run, epoch, round(score, 8) AS score, best, unimproved, stop, false AS late FROM t", "epochs")
def _(spark, d):
    """Late epochs come first, then every other one of the rest, and at last what fills the gaps."""
    return _early_stop(spark, d, ("epoch > 9", "epoch <= 9 and epoch % 2 = 0", "epoch <= 9 and epoch % 2 = 1"))


@query("str4_stream_epoch_logs", EPOCH_ROWS.replace("'r' || run AS run, ", ""), "epochs")
def _(spark, d):
    at = scratch(spark, "lines")
    _lines(spark, d).select("value").repartition(3).write.text(at)
    got = drained(streams.stream_epoch_logs(spark, at, 1), spark, "append", "run string, epoch int, secs int, train_loss double, train_r double, train_r2 double, valid_loss double, valid_r double, valid_r2 double, best boolean")
    return got.select(*EPOCH_COLS[1:])


