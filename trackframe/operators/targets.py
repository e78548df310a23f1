"""Target tables: undoing their transforms, strand pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.operators.ordered import running_sum


def with_target_info(preds: DataFrame, targets: DataFrame) -> DataFrame:
    return preds.join(targets, "target_idx")


def untransform(p: Column, scale: Column, clip_soft: Column, sum_stat: Column, unscale: bool = False, unclip: bool = True) -> Column:
    """Undo the soft clip, then the root of targets whose sum_stat names it, then the scale if asked."""
    if unclip:
        p = F.when(p > clip_soft, clip_soft - 1 + (p - clip_soft + 1) * (p - clip_soft + 1)).otherwise(p)
    p = F.when(F.contains(sum_stat, F.lit("_sqrt")), (p + 1) * (p + 1) - 1).otherwise(p)
    return p / scale if unscale else p


def untransform_old(p: Column, scale: Column, clip_soft: Column, sum_stat: Column, unscale: bool = False, unclip: bool = True) -> Column:
    """The former order: scale, soft clip, the 3/4 power, and the scale back unless unscale."""
    p = p / scale
    if unclip:
        p = F.when(p > clip_soft, clip_soft + (p - clip_soft) * (p - clip_soft)).otherwise(p)
    p = F.when(F.contains(sum_stat, F.lit("_sqrt")), F.pow(p, F.lit(4 / 3))).otherwise(p)
    return p if unscale else p * scale


def untransform_generic(p: Column, transform: float, scale: float = 1.0, clip_soft: float | None = None, old: bool = False) -> Column:
    """Either order with one exponent 1 / transform for all targets."""
    if old:
        p = p / scale
        if clip_soft is not None:
            p = F.when(p > clip_soft, (p - clip_soft) * (p - clip_soft) + clip_soft).otherwise(p)
        return F.pow(p, F.lit(1 / transform))
    if clip_soft is not None:
        p = F.when(p > clip_soft, (p - clip_soft + 1) * (p - clip_soft + 1) + clip_soft - 1).otherwise(p)
    return (F.pow(p + 1, F.lit(1 / transform)) - 1) / scale


def score_transform(num: Column, den: Column | None = None, pseudo: float = 0.0, log_odds: bool = False, raw: bool = False) -> Column:
    """A score of aggregates: raw, log, log ratio or log odds of the ratio; NULL where the logarithm has no value."""
    small = 1e-6
    if raw:
        return num
    if den is None:
        x = num + pseudo + small
    else:
        x = F.try_divide(num + pseudo, den + pseudo)
        x = F.try_divide(x, 1 - x) + small if log_odds else x + small
    return F.when(x > 0, F.ln(x))


def strand_groups(targets: DataFrame) -> DataFrame:
    """Adds group_id: the output row of each target when strand pairs are merged, in target order.

    A group ends at a target that is its own pair or ends in '-'; how many ends lie before a target is a running sum dealt
    out by ranges of target_idx.
    """
    end = F.when((F.col("strand_pair") == F.col("target_idx")) | F.endswith("identifier", F.lit("-")), F.lit(1)).otherwise(F.lit(0)).cast("long")
    summed = running_sum(targets, [], "target_idx", "group_id", F.coalesce(end, F.lit(0)))
    return summed.withColumn("group_id", F.col("group_id") - F.coalesce(end, F.lit(0)))


def merge_strand_pairs(preds: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions summed over the targets of a group."""
    return preds.join(strand_groups(targets).select("target_idx", "group_id"), "target_idx").groupBy(*keys, "group_id").agg(F.sum("y_pred").alias("y_pred"))


def collapse_strand_targets(targets: DataFrame) -> DataFrame:
    """Adds strand ('.' for a target that is its own pair, else the identifier's last letter) and drops '-'."""
    strand = F.when(F.col("strand_pair") == F.col("target_idx"), ".").otherwise(F.right("identifier", F.lit(1)))
    return targets.withColumn("strand", strand).where("strand <> '-'")


def swap_strand_pairs(preds: DataFrame, targets: DataFrame, length: int) -> DataFrame:
    """Rows of reverse-complemented inputs (is_rc): position mirrored, target exchanged with its pair."""
    both = preds.join(targets.select("target_idx", "strand_pair"), "target_idx")
    turned = F.col("is_rc")
    return both.withColumn("pos", F.when(turned, length - 1 - F.col("pos")).otherwise(F.col("pos"))).withColumn("target_idx", F.when(turned, F.col("strand_pair")).otherwise(F.col("target_idx"))).drop("strand_pair")
