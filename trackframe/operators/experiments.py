"""Hyperparameter grids, epoch logs and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The metrics of an epoch line, in its order.
METRICS = ("train_loss", "train_r", "train_r2", "valid_loss", "valid_r", "valid_r2")


def parse_epoch_lines(lines: DataFrame, line: str = "value", run: str = "run") -> DataFrame:
    """(run, epoch, secs, six metrics, best) of log lines; numbers may be negative, others lines are left out."""
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    got = lambda pattern, kind: F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast(kind)
    out = lines.where(F.col(line).rlike(r"Epoch\s+[0-9]+\s+-"))
    return out.select(run, got(r"Epoch\s+([0-9]+)", "int").alias("epoch"), got(r"-\s*([0-9]+)s", "int").alias("secs"), *(got(rf"\b{m}: {number}", "double").alias(m) for m in METRICS), F.contains(F.col(line), F.lit("best!")).alias("best"))


def last_best_epoch(epochs: DataFrame) -> DataFrame:
    """Per run the values of its last best epoch."""
    cols = [c for c in epochs.columns if c not in ("run", "best")]
    return epochs.where("best").groupBy("run").agg(F.max_by(F.struct(*cols), "epoch").alias("e")).select("run", "e.*")


def early_stopping_trace(epochs: DataFrame, min_epochs: int, patience: int, score=None, mode: str = "max", reaching: bool = False) -> DataFrame:
    """Adds score, best, unimproved and stop to each epoch of a run.

    score: valid_r + valid_r2 / 4 unless given. An epoch is best if strictly better than all before. stop: epoch >=
    min_epochs and unimproved > patience (>= with `reaching`). A run's epochs are one window.
    """
    s = score if score is not None else F.col("valid_r") + F.col("valid_r2") / 4
    e = epochs.withColumn("score", s)
    key = F.col("score") if mode == "max" else -F.col("score")
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("best_before", F.max(key).over(before)).withColumn("best", F.col("best_before").isNull() | (key > F.col("best_before"))).drop("best_before")
    e = e.withColumn("unimproved", (F.col("epoch") - F.max(F.when(F.col("best"), F.col("epoch"))).over(upto)).cast("int"))
    late = F.col("unimproved") >= patience if reaching else F.col("unimproved") > patience
    return e.withColumn("stop", (F.col("epoch") >= min_epochs) & late)


def first_stop(trace: DataFrame) -> DataFrame:
    return trace.where("stop").groupBy("run").agg(F.min("epoch").alias("stop_epoch"))


def parse_param_grid(grid: DataFrame) -> DataFrame:
    """(path, text) -> (path, place, value, kind): comma lists; kind int, double or string."""
    item = grid.select("path", F.posexplode(F.split("text", ",")).alias("place", "raw")).withColumn("raw", F.trim("raw"))
    number = F.when(F.col("raw").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col("raw").cast("double"))
    whole = number.isNotNull() & (number == F.floor(number))
    value = F.when(whole, number.cast("long").cast("string")).otherwise(F.col("raw"))
    return item.select("path", "place", value.alias("value"), F.when(whole, "int").when(number.isNotNull(), "double").otherwise("string").alias("kind"))


def grid_product(params: DataFrame, paths: list[str], seeds: list[int]) -> DataFrame:
    """Every combination of the values at `paths` (the last changes fastest) and seeds: exp_name, seed, one column a path.

    The result is the grid; its number comes from the values' places, not from row order.
    """
    sizes = params.groupBy("path").agg(F.count("*").alias("n"))
    sized = params.join(sizes, "path")
    each = [sized.where(F.col("path") == p).select(F.col("value").alias(f"v{k}"), F.col("place").alias(f"i{k}"), F.col("n").alias(f"n{k}")) for k, p in enumerate(paths)]
    full = reduce(lambda a, b: a.crossJoin(b), each)
    number = reduce(lambda a, k: a * F.col(f"n{k}") + F.col(f"i{k}"), range(len(paths)), F.lit(0))
    out = full.withColumn("number", number).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    name = F.concat(F.lit("exp_"), F.col("number").cast("string"), F.lit("_seed_"), F.col("seed").cast("string"))
    return out.select(name.alias("exp_name"), "seed", *(F.col(f"v{k}").alias(p) for k, p in enumerate(paths)))


def override_params(experiments: DataFrame, base: DataFrame) -> DataFrame:
    """(exp_name, path, value): base(path, value) with the values of experiments(exp_name, path, value) in their place."""
    names = experiments.select("exp_name").distinct()
    own = experiments.select("exp_name", "path", F.col("value").alias("own"))
    return names.crossJoin(base).join(own, ["exp_name", "path"], "left").select("exp_name", "path", F.coalesce("own", "value").alias("value"))


def pending_experiments(configs: DataFrame, log: DataFrame) -> DataFrame:
    return configs.join(log.where("status = 'success'"), "exp_name", "left_anti")


def experiments_with_config(log: DataFrame, configs: DataFrame) -> DataFrame:
    """Log entries with the configuration of their name; what has none is left out."""
    return log.join(configs, "exp_name")


def merge_experiment_log(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The newest entry of each experiment."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != "exp_name"]
    return both.groupBy("exp_name").agg(F.max_by(F.struct(*rest), order).alias("e")).select("exp_name", "e.*")


def seed_report(results: DataFrame, seeds: list[int]) -> DataFrame:
    """(base, valid_r_mean, valid_r_std, valid_r_seed_<s>): over the seeds of each experiment, by real seed."""
    col = lambda s: F.max(F.when(F.col("seed") == s, F.col("valid_r"))).alias(f"valid_r_seed_{s}")
    return results.groupBy("base").agg(F.avg("valid_r").alias("valid_r_mean"), F.stddev_pop("valid_r").alias("valid_r_std"), *map(col, seeds))


def rank_experiments(report: DataFrame, by: str = "valid_r_mean") -> DataFrame:
    return report.orderBy(F.col(by).desc_nulls_last(), report.columns[0])
