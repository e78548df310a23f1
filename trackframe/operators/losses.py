"""Losses as column expressions over long tables; each row's terms are summed before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what keeps logarithms off zero.
EPSILON = 1e-7


def poisson(t: Column, p: Column) -> Column:
    return p - t * F.ln(p + EPSILON)


def binary_crossentropy(t: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -(t * F.ln(q) + (1 - t) * F.ln(1 - q))


def squared_error(t: Column, p: Column) -> Column:
    return (t - p) * (t - p)


def mean_loss(df: DataFrame, term: Column, row: str) -> DataFrame:
    """Mean over each row's targets, then over rows."""
    return df.groupBy(row).agg(F.avg(term).alias("l")).agg(F.avg("l").alias("loss"))


def mse_udot(df: DataFrame, row: str, weight: float = 1.0) -> DataFrame:
    """Squared error minus weight times the mean product of each row's centred truths and predictions."""
    t, p = F.col("y_true"), F.col("y_pred")
    s = df.groupBy(row).agg(F.avg(squared_error(t, p)).alias("mse"), (F.avg(t * p) - F.avg(t) * F.avg(p)).alias("dot"))
    return s.agg(F.avg(F.col("mse") - weight * F.col("dot")).alias("loss"))


def poisson_kl(df: DataFrame, row: str, weight: float = 1.0) -> DataFrame:
    """Poisson plus weight times the divergence of each row's truths and predictions, scaled to sum to one.

    The divergence of scaled values is sum(t ln(t / p)) / T - ln(T / P), with T and P the row's totals, so one pass is enough.
    """
    t, p = F.col("y_true"), F.col("y_pred")
    te, pe = t + EPSILON, p + EPSILON
    s = df.groupBy(row).agg(F.avg(poisson(t, p)).alias("poisson"), F.sum(te).alias("tt"), F.sum(pe).alias("pp"), F.sum(te * F.ln(te / pe)).alias("tl"))
    return s.agg(F.avg(F.col("poisson") + weight * (F.col("tl") / F.col("tt") - F.ln(F.col("tt") / F.col("pp")))).alias("loss"))


def position_weight(pos: Column, length: int, weight_range: float = 1.0, exponent: int = 4) -> Column:
    """Weight of a position, 1 at the most central one and less outwards; an error for weight_range below 1."""
    if weight_range < 1:
        raise ValueError("weight_range must be at least 1")
    if weight_range == 1:
        return F.lit(1.0)
    first = -(length / 2 - 0.5)
    sigma = -first / math.log(weight_range) ** (1 / exponent)
    highest = max(math.exp(-(((first + i) / sigma) ** exponent)) for i in range(length))
    return F.exp(-F.pow((pos + first) / sigma, F.lit(exponent))) / highest


def poisson_multinomial(df: DataFrame, row: str, length: int, total_weight: float = 1.0, weight_range: float = 1.0, exponent: int = 4, rescale: bool = False) -> DataFrame:
    """Mean over (row, target) of the multinomial term plus total_weight times the Poisson term of the sums.

    -sum((wt + e) ln((wp + e) / P)) splits into sums that are added before the shuffle: P is the sum of the
    weighted predictions without e, as the reference has it.
    """
    w = position_weight(F.col("pos"), length, weight_range, exponent)
    whole = sum(math.exp(-(((i - (length / 2 - 0.5)) / ((length / 2 - 0.5) / math.log(weight_range) ** (1 / exponent))) ** exponent)) for i in range(length)) if weight_range > 1 else float(length)
    if weight_range > 1:
        first = -(length / 2 - 0.5)
        sigma = -first / math.log(weight_range) ** (1 / exponent)
        whole /= max(math.exp(-(((first + i) / sigma) ** exponent)) for i in range(length))
    t, p = w * F.col("y_true"), w * F.col("y_pred")
    s = df.groupBy(row, "target_idx").agg(F.sum(t).alias("st"), F.sum(p).alias("sp"), F.sum((t + EPSILON) * F.ln(p + EPSILON)).alias("dot"), F.sum(t + EPSILON).alias("te"))
    multinomial = (F.col("te") * F.ln("sp") - F.col("dot")) / whole
    loss = multinomial + total_weight * poisson(F.col("st"), F.col("sp")) / whole
    return s.agg(F.avg(loss * (2 / (1 + total_weight)) if rescale else loss).alias("loss"))


def loss(name: str, df: DataFrame, row: str, length: int = 1) -> DataFrame:
    """A loss by label; any other label is poisson. poisson_mn needs columns pos and target_idx."""
    t, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    made = {
        "mse": lambda: mean_loss(df, squared_error(t, p), row), "bce": lambda: mean_loss(df, binary_crossentropy(t, p), row), "mse_udot": lambda: mse_udot(df, row),
        "poisson_kl": lambda: poisson_kl(df, row), "poisson_mn": lambda: poisson_multinomial(df, row, length),
    }
    return made.get(name, lambda: mean_loss(df, poisson(t, p), row))()
