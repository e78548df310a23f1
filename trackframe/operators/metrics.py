"""Evaluation metrics from sums that are added up before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators import ordered

#: Predicted variance that counts as none; per-gene deviation and total that count as none; AUC thresholds.
NO_VARIANCE, NO_DEVIATION, NO_TOTAL, THRESHOLDS = 1e-12, 1e-10, 1e-10, 200


def pair(t: str = "y_true", p: str = "y_pred") -> tuple[Column, Column]:
    """Both values as doubles, NULL where either is."""
    a, b = F.col(t).cast("double"), F.col(p).cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def moment_sums(t: str = "y_true", p: str = "y_pred") -> list[Column]:
    """The mergeable state of pearson and r2: six sums over the rows that have both values."""
    a, b = pair(t, p)
    return [F.count(a).alias("n"), F.sum(a).alias("st"), F.sum(b).alias("sp"), F.sum(a * a).alias("stt"), F.sum(b * b).alias("spp"), F.sum(a * b).alias("stp")]


def pearson_of_sums() -> Column:
    """r of the six sums: 0 for predictions without variance, NULL for truths without."""
    tvar = F.nullif(F.greatest(F.col("stt") - F.try_divide(F.col("st") * F.col("st"), F.col("n")), F.lit(0.0)), F.lit(0.0))
    pvar = F.col("spp") - F.try_divide(F.col("sp") * F.col("sp"), F.col("n"))
    cov = F.col("stp") - F.try_divide(F.col("st") * F.col("sp"), F.col("n"))
    return F.when(pvar <= NO_VARIANCE, F.when(tvar.isNotNull(), 0.0)).otherwise(F.try_divide(cov, F.sqrt(tvar) * F.sqrt(pvar)))


def r2_of_sums() -> Column:
    """1 - residual / total; NULL for truths without variance."""
    total = F.nullif(F.greatest(F.col("stt") - F.try_divide(F.col("st") * F.col("st"), F.col("n")), F.lit(0.0)), F.lit(0.0))
    return 1 - F.try_divide(F.col("spp") - 2 * F.col("stp") + F.col("stt"), total)


def by_target(obs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, pearsonr, r2."""
    return obs.groupBy(*keys).agg(*moment_sums()).select(*keys, "n", pearson_of_sums().alias("pearsonr"), r2_of_sums().alias("r2"))


def summarize(metrics: DataFrame, *names: str) -> DataFrame:
    """Plain means over targets, NULL left out."""
    return metrics.agg(*(F.avg(c).alias(c) for c in names))


def by_gene(obs: DataFrame, key: str = "gene_idx") -> DataFrame:
    """key, pearsonr, r2 across targets, within [-1, 1]; NULL where truth or prediction is constant."""
    flat_t, flat_p = (F.stddev_pop(c) < NO_DEVIATION for c in pair())
    s = obs.groupBy(key).agg(*moment_sums(), flat_t.alias("flat_t"), flat_p.alias("flat_p"))
    flat = F.col("flat_t") | F.col("flat_p")
    total = F.col("stt") - F.try_divide(F.col("st") * F.col("st"), F.col("n"))
    bound = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return s.select(key, F.when(~flat, bound(pearson_of_sums())).alias("pearsonr"), F.when(~flat, F.when(total <= NO_TOTAL, 0.0).otherwise(bound(r2_of_sums()))).alias("r2"), flat.alias("constant"))


def average_rank(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Rank of value inside key; ties share the mean of their ranks."""
    tied = Window.partitionBy(key, value)
    return df.withColumn(out, F.rank().over(Window.partitionBy(key).orderBy(value)) + (F.count("*").over(tied) - 1) / 2)


def spearman_by_gene(obs: DataFrame, key: str = "gene_idx") -> DataFrame:
    t, p = pair()  # rows without one of both rank below all others, and are left out of the sums
    both = obs.withColumn("y_true", t).withColumn("y_pred", p)
    ranked = average_rank(average_rank(both, key, "y_true", "rt"), key, "y_pred", "rp").withColumn("rt", F.when(F.col("y_true").isNotNull(), F.col("rt")))
    s = ranked.groupBy(key).agg(*moment_sums("rt", "rp"), (F.min("y_pred") == F.max("y_pred")).alias("flat"))
    return s.select(key, F.when(~F.col("flat"), pearson_of_sums()).alias("spearmanr"))


def spearman(obs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spearmanr of rows with both values, for keys of any size, such as whole targets; NULL where one side is constant."""
    t, p = pair()
    both = obs.select(*keys, t.alias("y_true"), p.alias("y_pred")).where("y_true is not null and y_pred is not null")
    ranked = ordered.average_rank(ordered.average_rank(both, keys, "y_true", "rt"), keys, "y_pred", "rp")
    s = ranked.groupBy(*keys).agg(*moment_sums("rt", "rp"), (F.min("y_pred") == F.max("y_pred")).alias("flat"))
    return s.select(*keys, F.when(~F.col("flat"), pearson_of_sums()).alias("spearmanr"))


def gene_summary(genes: DataFrame) -> DataFrame:
    """One row: means over genes that have a value, how many are constant, and the share that has one."""
    return genes.agg(F.count("*").alias("n_genes"), F.count_if("constant").alias("n_constant"), F.avg("pearsonr").alias("pearsonr_mean"), F.avg("r2").alias("r2_mean"), (100.0 * F.count("pearsonr") / F.count("*")).alias("valid_percent"))


def roc_buckets(obs: DataFrame, key: str = "target") -> DataFrame:
    """(key, bucket, pos, neg): how many thresholds i / (THRESHOLDS - 1) lie below the prediction, summed before the shuffle.

    Rows without truth or prediction count for nothing.
    """
    bucket = F.greatest(F.lit(0), F.ceil(F.col("y_pred") * (THRESHOLDS - 1)) - 1).cast("int")
    both = obs.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    return both.groupBy(key, bucket.alias("bucket")).agg(F.sum(F.col("y_true").cast("long")).alias("pos"), F.sum(1 - F.col("y_true").cast("long")).alias("neg"))


def reverse_cumulative(buckets: DataFrame, key: str = "target") -> DataFrame:
    """tp, fp at each bucket's threshold (sums of the buckets at or above it), and those of the next bucket up.

    A key has THRESHOLDS buckets at most, so the windows are small. The lowest threshold lies below every
    prediction of 0 too, which are in bucket 0.
    """
    up = Window.partitionBy(key).orderBy(F.col("bucket").desc())
    run = up.rowsBetween(Window.unboundedPreceding, 0)
    out = buckets.withColumn("tp", F.sum("pos").over(run)).withColumn("fp", F.sum("neg").over(run))
    zero = F.lit(0).cast("long")
    every = Window.partitionBy(key)
    return out.withColumn("tp_up", F.lag("tp", 1, 0).over(up)).withColumn("fp_up", F.lag("fp", 1, 0).over(up)).withColumn("all_pos", F.sum("pos").over(every)).withColumn("all_neg", F.sum("neg").over(every) + zero)


def auroc(obs: DataFrame, key: str = "target", summation: str = "interpolation") -> DataFrame:
    """Area under the ROC over 200 thresholds by trapezoids, or by the lower ('minoring') or upper ('majoring') side."""
    c = reverse_cumulative(roc_buckets(obs, key), key)
    x = F.coalesce(F.try_divide(F.col("fp") - F.col("fp_up"), F.col("all_neg")), F.lit(0.0))
    low, high = (F.coalesce(F.try_divide(F.col(k), F.col("all_pos")), F.lit(0.0)) for k in ("tp_up", "tp"))
    height = {"interpolation": (low + high) / 2, "minoring": low, "majoring": high}[summation]
    return c.groupBy(key).agg(F.sum(x * height).alias("auroc"))


def auprc(obs: DataFrame, key: str = "target") -> DataFrame:
    """Interpolated area under precision and recall over the same thresholds."""
    c = reverse_cumulative(roc_buckets(obs, key), key)
    p, up = F.col("tp") + F.col("fp"), F.col("tp_up") + F.col("fp_up")
    dtp = F.col("tp") - F.col("tp_up")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    slope = zero(F.try_divide(dtp, p - up))
    log = F.when((p > 0) & (up > 0), F.ln(zero(F.try_divide(p, up)))).otherwise(0.0)
    step = slope * (dtp + (F.col("tp_up") - slope * up) * log)
    return c.groupBy(key).agg(F.sum(zero(F.try_divide(step, F.col("all_pos")))).alias("auprc"))
