"""In-silico mutagenesis tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.operators.ordered import running_sum


def variant_deltas(wild: DataFrame, mutants: DataFrame, keys: list[str]) -> DataFrame:
    """Score of the wild type less that of each mutant."""
    return mutants.join(wild, keys).withColumn("delta", F.col("score_wt") - F.col("score_mut"))


def window_deltas(windows: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """variant_deltas of `wild` and `mutant` windows, which `delta` replaces: both scores come from one row, so nothing is joined or shuffled."""
    return windows.withColumn("delta", score(F.col("wild")) - score(F.col("mutant"))).drop("wild", "mutant")


def by_sequence(seqs: DataFrame) -> DataFrame:
    """The sequences dealt by seq_id: what is told of whole sequences' positions then meets where it is made, and only their letters are shuffled."""
    return seqs.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id")


def ism_importance(deltas: DataFrame) -> DataFrame:
    """Per position, the deltas over four bases (the reference's is 0), averaged over folds."""
    fold = deltas.groupBy("seq_id", "pos", "fold").agg((F.sum("delta") / 4).alias("d"))
    return fold.groupBy("seq_id", "pos").agg(F.avg("d").alias("importance"))


def shuffle_importance(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("seq_id", "pos").agg(F.avg("delta").alias("importance"))


def dominant_base(scores: DataFrame) -> DataFrame:
    """Per position the base with the largest absolute score (the first of ties) and the sum of scores."""
    return scores.groupBy("seq_id", "pos").agg(F.max_by("base", F.struct(F.abs("value"), -F.col("base"))).alias("base"), F.sum("value").alias("total"))


def score_bounds(a: DataFrame, b: DataFrame, margin: float = 0.05) -> DataFrame:
    """Joint range of two score columns `value`, widened by a margin on both sides."""
    s = a.select("value").union(b.select("value")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return s.select((F.col("lo") - margin * (F.col("hi") - F.col("lo"))).alias("low"), (F.col("hi") + margin * (F.col("hi") - F.col("lo"))).alias("high"))


def fold_change(coverage: DataFrame, targets: DataFrame) -> DataFrame:
    """Mutant over wild type of the bins' sums of fold means, averaged by description to 4 decimals, ascending.

    coverage: (kind 'wt' or 'mut', fold, bin_idx, target_idx, value).
    """
    mean = coverage.groupBy("kind", "target_idx", "bin_idx").agg(F.avg("value").alias("v"))
    total = mean.groupBy("target_idx").agg(F.sum(F.when(F.col("kind") == "mut", F.col("v"))).alias("mut"), F.sum(F.when(F.col("kind") == "wt", F.col("v"))).alias("wt"))
    change = total.select("target_idx", F.try_divide("mut", "wt").alias("change")).join(targets, "target_idx")
    return change.groupBy("description").agg(F.round(F.avg("change"), 4).alias("fold_change")).orderBy("fold_change", "description")


def order_by_fold_change(changes: DataFrame) -> DataFrame:
    """(description, fold_change) with `place` from 1 by ascending fold change, ties by description; dealt out by ranges of the change."""
    return running_sum(changes, [], "fold_change", "place", ties=("description",))
