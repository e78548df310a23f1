"""Tables of bin pairs of a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = {
    "mean": lambda a, b: (a + b) / 2, "max": F.greatest, "multiply": lambda a, b: a * b, "multiply1": lambda a, b: (a + 1) * (b + 1) - 1,
    "concat": lambda a, b: F.array(a, b),
}


def pairwise_bins(df: DataFrame, operation: str, offset: int | None = None) -> DataFrame:
    """(seq_id, i, j, value) of all bins of a sequence, or of those with j >= i + offset, tested inside the join.

    Every pair is the result that is asked for, so it grows with the square of a sequence's bins, never across
    sequences.
    """
    a, b = df.select("seq_id", F.col("pos").alias("i"), F.col("value").alias("a")), df.select(F.col("seq_id").alias("s_"), F.col("pos").alias("j"), F.col("value").alias("b"))
    on = F.col("seq_id") == F.col("s_")
    if offset is not None:
        on = on & (F.col("j") >= F.col("i") + offset)
    return a.join(b, on).select("seq_id", "i", "j", OPERATIONS[operation](F.col("a"), F.col("b")).alias("value"))


def pairwise_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", F.abs(F.col("i") - F.col("j")))


def upper_triangle(pairs: DataFrame, offset: int = 2) -> DataFrame:
    return pairs.where(F.col("j") >= F.col("i") + offset)


def symmetrize(pairs: DataFrame) -> DataFrame:
    """(M_ij + M_ji) / 2: both orders of a pair are averaged by one aggregate, without a self join."""
    low, high = F.least("i", "j"), F.greatest("i", "j")
    mean = pairs.groupBy("seq_id", low.alias("lo"), high.alias("hi")).agg(F.avg("value").alias("value"))
    both = F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j")))).otherwise(F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j")), F.struct(F.col("hi").alias("i"), F.col("lo").alias("j"))))
    return mean.withColumn("ij", F.explode(both)).select("seq_id", "ij.i", "ij.j", "value")


def reverse_triangle(pairs: DataFrame, length: Column | int) -> DataFrame:
    """The pair table of the reverse-complemented sequence."""
    n = length if isinstance(length, Column) else F.lit(length)
    return pairs.select("seq_id", (n - 1 - F.col("j")).alias("i"), (n - 1 - F.col("i")).alias("j"), "value")


def apply_components(coefficients: DataFrame, components: DataFrame) -> DataFrame:
    """(row_idx, feature, value): coefficients(row_idx, component, w) times components(component, feature, c)."""
    return coefficients.join(components, "component").groupBy("row_idx", "feature").agg(F.sum(F.col("w") * F.col("c")).alias("value"))


def attention_mean(att: DataFrame, folds: list[int], layers: list[int], heads: list[int]) -> DataFrame:
    return att.where(F.col("fold").isin(folds) & F.col("layer").isin(layers) & F.col("head").isin(heads)).groupBy("seq_id", "q", "k").agg(F.avg("w").alias("w"))
