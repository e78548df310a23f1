"""Writers; each is one Spark write, committed whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.operators.matrix import transpose_packed
from trackframe.operators.splits import shards


def write_split_shards(examples: DataFrame, path: str, size: int = 64, key: str = "gene_idx", seed: int = 0) -> None:
    """Examples as Parquet, partitioned by split; consecutive groups of `size` share a shard and a file."""
    numbered = shards(examples, key, size, seed)
    numbered.repartition("split", "shard").sortWithinPartitions("split", "shard").write.partitionBy("split").parquet(path)


def feature_matrix(tracks: DataFrame) -> DataFrame:
    """(gene_idx, features) of tracks(track_idx, gene_idx, bins): array<array<float>> [bins][tracks], tracks in order of track_idx."""
    rows = tracks.groupBy("gene_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("track_idx", "bins"))), lambda t: t["bins"]).alias("rows"))
    return rows.select("gene_idx", transpose_packed(F.col("rows")).cast("array<array<float>>").alias("features"))


def write_feature_shards(tracks: DataFrame, labels: DataFrame, splits: DataFrame, path: str, size: int = 64, seed: int = 0) -> None:
    """Examples for training: each gene's tracks as a matrix [bins][tracks] and its targets, single precision, in shards of `size` genes by split.

    tracks(track_idx, gene_idx, bins), labels(gene_idx, target_idx, y_true), splits(gene_idx, split). The shards are in `path`/shards, the
    numbers of bins, tracks and targets, as JSON, in `path`/_shape; matrices of different shapes are an error, and nothing is told of them.
    """
    targets = labels.groupBy("gene_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("target_idx", "y_true"))), lambda t: t["y_true"]).cast("array<float>").alias("targets"))
    examples = feature_matrix(tracks).join(targets, "gene_idx").join(splits.select("gene_idx", "split"), "gene_idx")
    write_split_shards(examples, f"{path}/shards", size, "gene_idx", seed)
    written = examples.sparkSession.read.parquet(f"{path}/shards").select(F.size("features").alias("num_bins"), F.size(F.get("features", F.lit(0))).alias("num_tracks"), F.size("targets").alias("num_targets"))
    shapes = written.distinct().limit(2).collect()
    if len(shapes) > 1:
        raise ValueError(f"examples of different shapes: {shapes}")
    written.distinct().coalesce(1).write.json(f"{path}/_shape")


def fixed(value: Column | str, digits: int) -> Column:
    """A number as text with that many digits behind the point (halves away from zero)."""
    return F.format_string(f"%.{digits}f", F.round(F.col(value) if isinstance(value, str) else value, digits).cast("double"))


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.csv(path, sep="\t", header=True)


def write_targets_table(meta: DataFrame, split: DataFrame, path: str, key: str = "gene_idx") -> None:
    """Metadata and split in the genes' own order, which is kept in the index column."""
    write_tsv(meta.join(split.select(key, "split"), key), path, [key])


def statistics(examples: DataFrame, num_bins: int, num_tracks: int, target_names: list[str], method: str, ratios: tuple[float, float, float] | None = None, chromosomes: tuple[str, str] | None = None) -> DataFrame:
    """One row of facts about a dataset; split_method is the one that was used.

    With `ratios` also train_, valid_ and test_ratio; with `chromosomes` also test_chrom and valid_chrom.
    """
    n = lambda s: F.count_if(F.col("split") == s).alias(f"{s}_seqs")
    more = [F.lit(float(r)).alias(f"{s}_ratio") for s, r in zip(("train", "valid", "test"), ratios or (), strict=False)]
    more += [F.lit(c).alias(f"{s}_chrom") for s, c in zip(("test", "valid"), chromosomes or (), strict=False)]
    return examples.agg(F.count("*").alias("num_genes"), n("train"), n("valid"), n("test")).select("*", F.lit(num_bins).alias("num_bins"), F.lit(num_tracks).alias("num_tracks"), F.lit(method).alias("split_method"), F.lit(len(target_names)).alias("num_targets"), F.array(*map(F.lit, target_names)).alias("target_names"), *more)


def write_statistics(facts: DataFrame, path: str) -> None:
    facts.coalesce(1).write.json(path)


def bedgraph(values: DataFrame, pool_width: int, targets: list[int] | None = None) -> DataFrame:
    """(kind, target_idx, chrom, start, end, value) of values(kind, chrom, start, bin_idx, target_idx, value), the value as text with 2 decimals."""
    v = values.where(F.col("target_idx").isin(targets)) if targets is not None else values
    return v.select("kind", "target_idx", "chrom", (F.col("start") + F.col("bin_idx") * pool_width).alias("start"), (F.col("start") + (F.col("bin_idx") + 1) * pool_width).alias("end"), fixed("value", 2).alias("value"))


def write_bedgraph(values: DataFrame, path: str, pool_width: int, targets: list[int] | None = None) -> None:
    """A folder a kind and target, so that no target's file passes through one task with another's."""
    bedgraph(values, pool_width, targets).write.partitionBy("kind", "target_idx").csv(path, sep="\t")


def write_metric_table(metrics: DataFrame, path: str, order: list[str]) -> None:
    """Numbers with a fraction are written with 5 decimals."""
    text = [fixed(c, 5).alias(c) if k in ("double", "float") else F.col(c) for c, k in metrics.dtypes]
    write_tsv(metrics.select(*text), path, order)


def write_prediction_matrix(preds: DataFrame, path: str) -> None:
    preds.write.parquet(path)


def natural_columns(names: list[str]) -> list[str]:
    """Names in natural order: by text before the number, then the number."""
    import re

    split = lambda n: (re.match(r"\D*", n)[0], int((re.search(r"\d+", n) or ["-1"])[0]), n)
    return sorted(names, key=split)


def arrange_predictions(wide: DataFrame, gene: str = "gene_id") -> DataFrame:
    """geneID, means and deviations, then seeds, each in natural order; a single model has means named target_<k>."""
    rest = [c for c in wide.columns if c != gene]
    seeds = natural_columns([c for c in rest if "_seed_" in c])
    stats = natural_columns([c for c in rest if "_seed_" not in c])
    if len({c.rsplit("_", 1)[1] for c in seeds}) <= 1:
        return wide.select(F.col(gene).alias("geneID"), *(F.col(c).alias(c.removesuffix("_mean")) for c in stats if c.endswith("_mean")))
    return wide.select(F.col(gene).alias("geneID"), *stats, *seeds)


def write_wide_predictions(wide: DataFrame, path: str, gene: str = "gene_id") -> None:
    write_tsv(arrange_predictions(wide, gene), path)


def arrange_report(report: DataFrame, metrics: list[str]) -> DataFrame:
    """experiment, metrics, grid_* columns, then the others."""
    rest = [c for c in report.columns if c != "experiment" and c not in metrics]
    grid = [c for c in rest if c.startswith("grid_")]
    return report.select("experiment", *metrics, *grid, *(c for c in rest if c not in grid))


def write_experiment_report(report: DataFrame, path: str, metrics: list[str]) -> None:
    arrange_report(report, metrics).write.csv(path, header=True)


