"""Joins by key with checks, and small summaries of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def features_with_labels(features: DataFrame, labels: DataFrame, key: str = "gene_idx") -> DataFrame:
    """features joined with labels by key; an error if their numbers differ or a key lacks its partner."""
    side = lambda df, a, b: df.select(F.col(key).alias("key"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    each = side(features, 1, 0).union(side(labels, 0, 1)).groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n, m, lost = each.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "ab"), F.count_if((F.col("a") == 0) | (F.col("b") == 0) | F.col("key").isNull())).first()
    if n != m:
        raise ValueError(f"{n} rows of features for {m} of labels")
    if lost:
        raise ValueError(f"{lost} keys without a partner")
    return features.join(labels, key)


def preds_with_targets(preds: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions and truths of the same keys; what lacks a partner is left out."""
    return preds.join(targets, keys)


def attach_gene_ids(rows: DataFrame, ids: DataFrame, key: str = "gene_idx", name: str = "id", out: str = "GeneID") -> DataFrame:
    """rows with the id of their index as `out` ('Gene_<index + 1>' where there is none) and the other columns of ids."""
    made = F.coalesce(F.col(name), F.concat(F.lit("Gene_"), (F.col(key) + 1).cast("string")))
    return rows.join(ids, key, "left").withColumn(out, made).drop(name)


def target_sum(preds: DataFrame, targets: list[int], keys: list[str], value: str = "y_pred") -> DataFrame:
    """Sum over the selected targets."""
    return preds.where(F.col("target_idx").isin(targets)).groupBy(*keys).agg(F.sum(value).alias("value"))


def coverage_stats(tracks: DataFrame, seq: str = "gene_idx", target: str = "track_idx", bins: str = "bins") -> DataFrame:
    """One row: the number of sequences, and of targets with any value other than 0."""
    each = tracks.groupBy(target).agg(F.max(F.coalesce(F.exists(bins, lambda x: x != 0), F.lit(False))).alias("any"))
    counts = tracks.select(seq).distinct().agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    return counts.union(each.agg(F.lit(0).cast("long"), F.count_if("any"))).agg(F.sum("n").alias("num_seqs"), F.sum("m").alias("num_targets"))


def distinct_names(df: DataFrame, *names: str | Column) -> DataFrame:
    return df.select(*names).distinct()
