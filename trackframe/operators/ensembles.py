"""Ensembles over seeds, shifts and strands; scoring with user-supplied models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.sequences import reverse_complement, shift_sequence
from trackframe.operators.ordered import box_stats


def augment_shifts_rc(seqs: DataFrame, shifts: list[int], pad: str = "N") -> DataFrame:
    """Each sequence once a shift and strand: (seq_id, shift, is_rc, seq). Shifts are a parameter, a handful."""
    each = seqs.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("is_rc", F.explode(F.array(F.lit(False), F.lit(True))))
    moved = shift_sequence(F.col("seq"), F.col("shift"), pad)
    return each.withColumn("seq", F.when(F.col("is_rc"), reverse_complement(moved)).otherwise(moved))


def ensemble_average(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg("y_pred").alias("y_pred"))


def seed_mean_std(preds: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Mean and population deviation over seeds of each gene and exact target."""
    return preds.groupBy(gene, "target_idx").agg(F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("std"))


def seed_sample_std(preds: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Sample deviation over seeds; NULL for a single seed. Reverse genes (.Rp) have ids of their own."""
    return preds.groupBy(gene, "target_idx").agg(F.stddev_samp("y_pred").alias("std"))


def seed_box_stats(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles, mean and whiskers (the outermost values within 1.5 interquartile ranges); a key of any size is spread over tasks."""
    return box_stats(preds, keys, "y_pred")


def pivot_predictions(preds: DataFrame, targets: list[int], seeds: list[int], gene: str = "gene_id") -> DataFrame:
    """gene, then target_<k>_mean and _std, then target_<k>_seed_<m>; the lists are given, in their order.

    Rows are first summed by gene and target, which is narrow; a gene's few rows are then brought together before its wide row is made,
    so that no task holds wide rows of genes that are not its own.
    """
    free = "of_"  # before the names of helper columns, so that none clashes with the gene's
    while gene.lower().startswith(free):
        free = "_" + free
    target, mean, std = f"{free}target", f"{free}mean", f"{free}std"
    is_target = F.when(F.col("target_idx").isin(targets), F.col("target_idx")).alias(target)
    of_seed = [F.max(F.when(F.col("seed") == m, F.col("y_pred"))).alias(f"{free}seed_{i}") for i, m in enumerate(seeds)]
    each = preds.groupBy(gene, is_target).agg(F.avg("y_pred").alias(mean), F.stddev_pop("y_pred").alias(std), *of_seed).repartition(gene)
    value = lambda k, c, name: F.max(F.when(F.col(target) == k, F.col(c))).alias(f"target_{k}_{name}")
    stats = [value(k, c, n) for k in targets for n, c in (("mean", mean), ("std", std))]
    return each.groupBy(gene).agg(*stats, *(value(k, f"{free}seed_{i}", f"seed_{m}") for k in targets for i, m in enumerate(seeds)))


def score_linear(examples: DataFrame, models: DataFrame) -> DataFrame:
    """(row_idx, model, y_pred): sum of x * w over (feature) of every example and model; the weights' table is small."""
    return examples.join(models, "feature").groupBy("row_idx", "model").agg(F.sum(F.col("x") * F.col("w")).alias("y_pred"))


def score_batches(examples: DataFrame, models: dict[str, Callable], key: str, features: str, batch: int = 1024) -> DataFrame:
    """(key, model, y_pred array<double>) of models called on numpy batches (rows, features); more than one output axis is an error.

    Works on batch and streaming tables; models are sent to the tasks once a task.
    """
    kind = examples.schema[key].dataType.simpleString()

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                x = np.stack([np.asarray(v, dtype="float64") for v in part[features]])
                for name, model in models.items():
                    y = np.asarray(model(x), dtype="float64")
                    if y.ndim > 2:
                        raise ValueError(f"{name} gave {y.ndim} axes")
                    yield pd.DataFrame({key: part[key].to_numpy(), "model": name, "y_pred": list(y.reshape(len(part), -1))})

    return examples.select(key, features).mapInPandas(run, f"{key} {kind}, model string, y_pred array<double>")
