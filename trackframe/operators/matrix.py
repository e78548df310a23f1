"""Matrices as long tables (gene_idx, ..., value) and as packed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.operators.ordered import exact_quantiles


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "target", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def array_to_long(df: DataFrame, ids: list[str], column: str, pos: str = "pos", value: str = "value") -> DataFrame:
    return df.select(*ids, F.posexplode(column).alias(pos, value))


def long_to_array(df: DataFrame, ids: list[str], pos: str = "pos", value: str = "value", out: str = "bins") -> DataFrame:
    """Arrays in order of pos."""
    return df.groupBy(*ids).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda e: e[value]).alias(out))


def downcast(df: DataFrame, *columns: str, kind: str = "float") -> DataFrame:
    """Columns, numbers or arrays of them, in single precision (or another kind)."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast(f"array<{kind}>" if kinds[c].startswith("array") else kind) for c in columns})


def length_sum(df: DataFrame, keys: list[str], value: str = "y_pred") -> DataFrame:
    """Sum over all positions of a sequence and target."""
    return df.groupBy(*keys).agg(F.sum(value).alias("value"))


def transpose_packed(rows: Column) -> Column:
    """array<array> with rows and columns exchanged; [] for no row."""
    width = F.size(F.get(rows, F.lit(0)))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda b: F.transform(rows, lambda r: F.get(r, b)))).otherwise(F.array().cast("array<array<double>>"))


def center_crop(values: Column, keep: int) -> Column:
    """The central `keep` elements; all of a shorter array."""
    return F.slice(values, F.greatest(F.floor((F.size(values) - keep) / 2), F.lit(0)).cast("int") + 1, F.lit(keep))


def step_positions(df: DataFrame, step: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) % step == 0)


def slice_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets listed in targets(target_idx, out_idx), numbered by out_idx; the list is small."""
    return df.join(targets, "target_idx").drop("target_idx").withColumnRenamed("out_idx", "target_idx")


def slice_positions(df: DataFrame, positions: DataFrame) -> DataFrame:
    """df(seq_id, pos, value) at positions(seq_id, pos, mask or NULL, role); values are multiplied by the mask."""
    return df.join(positions, ["seq_id", "pos"]).withColumn("value", F.col("value") * F.coalesce("mask", F.lit(1.0)))


def position_aggregate(sliced: DataFrame, mean: bool) -> DataFrame:
    """Per sequence and role, the sum of masked values, or their mean: over the sum of masks where there are masks."""
    total = F.sum("value")
    return sliced.groupBy("seq_id", "role").agg((F.try_divide(total, F.coalesce(F.sum("mask"), F.count("*").cast("double"))) if mean else total).alias("value"))


def position_feature(pos: Column, length: Column, transform: str = "", power: float = 1.0) -> Column:
    """A position counted from the centre: plain, 'abs' or 'reversed', to a power."""
    x = pos - F.floor(length / 2)
    x = {"": x, "abs": F.abs(x), "reversed": length - 1 - pos - F.floor(length / 2)}[transform]
    return x.cast("double") if power == 1 else F.pow(x.cast("double"), F.lit(power))


def pool_bins(df: DataFrame, width: int, keys: list[str], pos: str = "pos") -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(pos) / width).alias("bin")).agg(F.avg("value").alias("value"))


def quantile_scale(df: DataFrame, keys: list[str], q: float, exact: bool = True) -> DataFrame:
    """Values over the q-quantile of their keys; exact by narrowed histograms, or sketched."""
    if exact:
        of = exact_quantiles(df, keys, "value", [q]).select(*keys, F.col("q")[0].alias("scale_"))
    else:
        of = df.groupBy(*keys).agg(F.percentile_approx("value", q, 10_000).alias("scale_"))
    return df.join(of, keys).withColumn("value", F.try_divide(F.col("value").cast("double"), F.col("scale_"))).drop("scale_")


def pad_ends(df: DataFrame, keys: list[str], length: int, pad: int, pos: str = "pos") -> DataFrame:
    """Positions moved by `pad`, with zeros before and after."""
    moved = df.select(*keys, (F.col(pos) + pad).cast("int").alias(pos), F.col("value").cast("double").alias("value"))
    zeros = df.select(*keys).distinct().withColumn(pos, F.explode(F.array(*(F.lit(i) for i in [*range(pad), *range(pad + length, 2 * pad + length)])))).withColumn("value", F.lit(0.0))
    return moved.unionByName(zeros)


def global_pool(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    return df.groupBy(*keys).agg({"mean": F.avg, "max": F.max}[kind]("value").alias("value"))


def softmax_pool(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Sum of values weighted by the softmax of a score column."""
    top = df.groupBy(*keys).agg(F.max(score).alias("top_"))
    e = F.exp(F.col(score) - F.col("top_"))
    return df.join(top, keys).groupBy(*keys).agg((F.sum(F.col("value") * e) / F.sum(e)).alias("value"))


def center_average(df: DataFrame, keys: list[str], length: int, center: int, pos: str = "pos") -> DataFrame:
    start = (length - center) // 2
    return df.where(F.col(pos).between(start, start + center - 1)).groupBy(*keys).agg(F.avg("value").alias("value"))


def length_average(df: DataFrame, keys: list[str], known: str, plain_sum: bool = False) -> DataFrame:
    """Mean over positions divided by the number of positions with a known base (or the sum divided by it)."""
    top = F.sum("value") if plain_sum else F.avg("value")
    return df.groupBy(*keys).agg(F.try_divide(top, F.sum(F.col(known).cast("double"))).alias("value"))


def mean_subtract(df: DataFrame) -> DataFrame:
    """value less the mean of its position's bases, from one aggregate a position."""
    mean = df.groupBy("seq_id", "pos").agg(F.avg("value").alias("mean_"))
    return df.join(mean, ["seq_id", "pos"]).withColumn("value", F.col("value") - F.col("mean_")).drop("mean_")


def input_gate(df: DataFrame) -> DataFrame:
    """Sum of each position's values times the one-hot base: (seq_id, pos, value)."""
    return df.groupBy("seq_id", "pos").agg(F.sum(F.col("value") * F.col("one_hot")).alias("value"))


def floor_below(value: Column, least: float) -> Column:
    return F.when(value < least, 0.0).otherwise(value)


def clip(value: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, F.lit(most)))
