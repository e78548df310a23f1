"""The given tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark, d):
    return t(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("target"), F.col("l_quantity").alias("y_true"), (F.col("l_extendedprice") / 2000).alias("y_pred"))


def clf(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_returnflag").alias("target"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("y_true"), (F.col("l_quantity") / 51).alias("y_pred"))


def mat(spark, d):
    """32 truths and 32 predictions a gene; the chromosome is the label."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("gene_idx"), F.col("label").alias("chrom"), "embedding", F.posexplode(F.slice("embedding", 1, 32)).alias("target_idx", "x"))
    return e.select("gene_idx", "chrom", "target_idx", F.col("x").cast("double").alias("y_true"), F.get("embedding", F.col("target_idx") + 32).cast("double").alias("y_pred"))


def pos_counts(spark, d):
    """Four targets by eight positions a sequence."""
    return mat(spark, d).select(F.col("gene_idx").alias("seq_id"), F.floor(F.col("target_idx") / 8).cast("int").alias("target_idx"), (F.col("target_idx") % 8).alias("pos"), (F.abs("y_true") * 10).alias("y_true"), (F.abs("y_pred") * 10).alias("y_pred"))


def tracks(spark, d):
    """Eight tracks of eight bins a gene."""
    e = t(spark, d, "embeddings").withColumn("track_idx", F.explode(F.expr("sequence(0, 7)")))
    return e.select("track_idx", F.col("vec_id").alias("gene_idx"), F.expr("slice(embedding, 8 * track_idx + 1, 8)").alias("bins"))


def bed(spark, d):
    o = t(spark, d, "orders")
    start = F.floor("o_totalprice")
    return o.select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 500).alias("end"), F.when(F.col("o_orderstatus") == "O", "-").otherwise("+").alias("strand"))


def ann(spark, d):
    s = F.floor("l_extendedprice")
    return t(spark, d, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"), s.alias("start"), (s + 50 + F.floor("l_quantity")).alias("end"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"), F.col("l_returnflag").alias("feature")).distinct()


def seqs(spark, d):
    """The letters ACGTN of every document."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^ACGTNacgtn]+", "")).alias("seq")).where("length(seq) > 0")


def targets(spark, d):
    p = t(spark, d, "part")
    k = F.col("p_partkey") % 3
    return p.select(
        F.col("p_partkey").alias("target_idx"), F.concat("p_name", F.when(k == 1, "+").when(k == 2, "-").otherwise("")).alias("identifier"), (F.col("p_partkey") + F.when(k == 1, 1).when(k == 2, -1).otherwise(0)).alias("strand_pair"),
        (1.0 + F.col("p_size") % 4).alias("scale"), F.col("p_size").cast("double").alias("clip_soft"), F.when(F.contains("p_type", F.lit("E")), "sum_sqrt").otherwise("sum").alias("sum_stat"), F.col("p_brand").alias("description"),
    )


def target_preds(spark, d):
    """A prediction for each of seven sequences and targets."""
    return t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("seq_id"), F.col("l_partkey").alias("target_idx")).agg(F.max("l_quantity").alias("y_pred"))


def seed_preds(spark, d):
    return t(spark, d, "lineitem").groupBy(F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene_id"), F.col("l_linenumber").alias("target_idx"), (F.col("l_suppkey") % 5).alias("seed")).agg(F.avg("l_quantity").alias("y_pred"))


def epochs(spark, d):
    """Runs are users, epochs their events in time order (a run's epochs are one window)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), (F.col("value") / 500).alias("valid_r"), (F.col("value") / 1000).alias("valid_r2"))


#: View -> SQL over the same tables.
SQL = {
    "obs": "SELECT l_returnflag || l_linestatus AS target, l_quantity AS y_true, l_extendedprice / 2000 AS y_pred FROM lineitem",
    "clf": "SELECT l_returnflag AS target, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y_true, l_quantity / 51 AS y_pred FROM lineitem",
    "mat": "SELECT vec_id AS gene_idx, label AS chrom, i::INT AS target_idx, embedding[i + 1]::DOUBLE AS y_true, embedding[i + 33]::DOUBLE AS y_pred FROM embeddings, range(0, 32) r(i)",
    "pos_counts": "SELECT gene_idx AS seq_id, (target_idx // 8)::INT AS target_idx, target_idx % 8 AS pos, abs(y_true) * 10 AS y_true, abs(y_pred) * 10 AS y_pred FROM mat",
    "tracks": "SELECT i::INT AS track_idx, vec_id AS gene_idx, embedding[8 * i + 1 : 8 * i + 8] AS bins FROM embeddings, range(0, 8) r(i)",
    "bed": "SELECT o_orderkey AS row_id, 'chr' || (o_custkey % 5) AS chrom, floor(o_totalprice)::BIGINT AS \"start\", floor(o_totalprice)::BIGINT + 1 + o_orderkey % 500 AS \"end\", CASE WHEN o_orderstatus = 'O' THEN '-' ELSE '+' END AS strand FROM orders",
    "ann": "SELECT DISTINCT 'chr' || (l_suppkey % 5) AS chrom, floor(l_extendedprice)::BIGINT AS \"start\", floor(l_extendedprice)::BIGINT + 50 + floor(l_quantity)::BIGINT AS \"end\", CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, l_returnflag AS feature FROM lineitem",
    "seqs": "SELECT * FROM (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents) WHERE length(seq) > 0",
    "targets": "SELECT p_partkey AS target_idx, p_name || CASE p_partkey % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '' END AS identifier, p_partkey + CASE p_partkey % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS strand_pair, 1.0::DOUBLE + p_size % 4 AS scale, p_size::DOUBLE AS clip_soft, CASE WHEN contains(p_type, 'E') THEN 'sum_sqrt' ELSE 'sum' END AS sum_stat, p_brand AS description FROM part",
    "target_preds": "SELECT l_suppkey % 7 AS seq_id, l_partkey AS target_idx, max(l_quantity) AS y_pred FROM lineitem GROUP BY ALL",
    "seed_preds": "SELECT 'G' || l_partkey AS gene_id, l_linenumber AS target_idx, l_suppkey % 5 AS seed, avg(l_quantity) AS y_pred FROM lineitem GROUP BY ALL",
    "epochs": "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS epoch, value / 500 AS valid_r, value / 1000 AS valid_r2 FROM events",
}


def with_views(body: str, *names: str) -> str:
    need = [n for n in SQL if n in names or (n == "mat" and "pos_counts" in names)]
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in need)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
