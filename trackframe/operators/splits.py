"""Splits, shuffles and shards, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators.dist import rank_within


def split_by_chromosome(df: DataFrame, test: str, valid: str, column: str = "chrom") -> DataFrame:
    """Adds split; chromosomes are compared as strings and test wins."""
    c = F.col(column).cast("string")
    return df.withColumn("split", F.when(c == test, "test").when(c == valid, "valid").otherwise("train"))


def split_random(df: DataFrame, key: str, train: float, valid: float, test: float, seed: int = 0) -> DataFrame:
    """Adds split with exact sizes int(n * train), int(n * valid) and the rest, in hash order of the key."""
    total = train + valid + test
    n = df.agg(F.count("*").alias("n_"))
    ranked = rank_within(df, [], key, seed, "rank_").crossJoin(F.broadcast(n))  # one row
    a, b = F.floor(F.col("n_") * (train / total)), F.floor(F.col("n_") * (valid / total))
    return ranked.withColumn("split", F.when(F.col("rank_") <= a, "train").when(F.col("rank_") <= a + b, "valid").otherwise("test")).drop("rank_", "n_")


def shuffle_rank(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds position: a random order that is new each epoch."""
    return rank_within(df, [], key, f"{seed}|{epoch}", "position")


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows, in the order of columns if given: each task sends n at most."""
    return (df.orderBy(*order) if order else df).limit(n)


def shards(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Adds shard: `size` rows of a split each, in hash order."""
    return rank_within(df, ["split"], key, seed, "rank_").withColumn("shard", F.floor((F.col("rank_") - 1) / size)).drop("rank_")


def split_counts(df: DataFrame, batch: int) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.floor(F.count("*") / batch).alias("batches"))


def split_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split; empty when the split is a partition."""
    return df.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")
