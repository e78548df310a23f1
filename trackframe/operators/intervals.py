"""Genomic intervals: 0-based, half open, starts may be negative until a sequence is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def center_windows(bed: DataFrame, length: int) -> DataFrame:
    """Windows of `length` around each interval's middle: adds mid, win_start, win_end."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    return bed.withColumn("mid", mid).withColumn("win_start", F.col("mid") - length // 2).withColumn("win_end", F.col("win_start") + length)


def per_base_windows(bed: DataFrame, length: int) -> DataFrame:
    """One window for each base of each interval; an empty interval has none.

    The intervals are dealt by ranges of the start first, since neighbours' windows are made of the same few numbers: written as columns, sorted ones take far fewer bytes.
    """
    n = int(bed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = bed.where("end > start").repartitionByRange(n, "start", "end").sortWithinPartitions("start", "end").withColumn("mid", F.explode(F.expr("sequence(start, end - 1)")))
    return at.withColumn("interval_length", F.col("end") - F.col("start")).withColumn("win_start", F.col("mid") - length // 2).withColumn("win_end", F.col("win_start") + length)


def to_bin(pos: Column, start: Column, width: int, crop: int = 0, offset: int = 0) -> Column:
    """Bin of a position in a window whose first `crop` bases have no bins, less `offset` bins."""
    return F.floor((pos - start - crop) / width) - offset


def bin_coordinates(start: Column, bin_idx: Column, width: int) -> tuple[Column, Column]:
    return start + bin_idx * width, start + (bin_idx + 1) * width


def filter_features(ann: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows of ann that match a row of settings(feature, strand or NULL, min_length, max_length); settings is small.

    It is broadcast, so that no feature's rows meet in one task and a distinct before it is made of the rows that match only.
    """
    size = F.col("a.end") - F.col("a.start")
    on = (F.col("a.feature") == F.col("s.feature")) & (F.col("s.strand").isNull() | (F.col("s.strand") == F.col("a.strand"))) & size.between(F.col("s.min_length"), F.col("s.max_length"))
    return ann.alias("a").join(F.broadcast(settings.alias("s")), on, "left_semi")


def concat_annotations(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
