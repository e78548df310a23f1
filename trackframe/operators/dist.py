"""Exact ranks without a global window, range joins through tiles, natural order of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.sequences import strand_sequence
from trackframe.operators.ordered import running


def rank_within(df: DataFrame, parts: list[str], key: str, seed: int | str = 0, name: str = "rank") -> DataFrame:
    """A 1-based rank in md5(key|seed) order inside `parts`, exact and the same on every run.

    Rows are numbered inside 65,536 hash buckets of each part (1.5 million rows a bucket at 10**11); the buckets'
    sizes, a small table, give each its first number. No task holds a whole part. Other columns may have any name.
    """
    free = "rank_"  # before the names of helper columns, so that none clashes with one of df
    while any(c.startswith(free) for c in df.columns):
        free = "_" + free
    hash_, bucket, b, n, own, first = (f"{free}{c}_" for c in ("hash", "bucket", "b", "n", "own", "first"))
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    marked = df.withColumn(hash_, h).withColumn(bucket, F.substring(hash_, 1, 4))
    sizes = marked.groupBy(*parts, bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy(*parts).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*(F.col(p).alias(f"{free}{p}") for p in parts), F.col(bucket).alias(b), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    on = F.col(bucket) == F.col(b)
    for p in parts:
        on = on & F.col(p).eqNullSafe(F.col(f"{free}{p}"))
    numbered = marked.withColumn(own, F.row_number().over(Window.partitionBy(*parts, bucket).orderBy(hash_, key)))
    out = numbered.join(firsts, on).withColumn(name, (F.col(own) + F.col(first)).cast("long"))
    return out.drop(hash_, bucket, b, own, first, *(f"{free}{p}" for p in parts))


#: Bins are this many times wider on each level; levels.
WIDER, LEVELS = 4, 20


def width_of(level: Column, size: int) -> Column:
    """How wide a level's bins are; level 0 has bins of `size`."""
    return (F.lit(size) * F.pow(F.lit(WIDER), level)).cast("long")


def bin_of(x: Column, level: Column, size: int) -> Column:
    """The bin of a position on a level."""
    return F.floor(x / width_of(level, size))


def level_of(length: Column, size: int) -> Column:
    """The first level whose bins are as wide as the length (the last one for all that is longer)."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= size * WIDER**k, F.lit(k)).otherwise(out)
    return out


def _bins(df: DataFrame, side: str, levels: DataFrame, size: int) -> DataFrame:
    """A row for each bin of [from, to) on its own level and on those of `levels` (one row, an array) above: two a level at most."""
    start, end, level, on, bin_ = (f"{side}_{c}" for c in ("from", "to", "level", "on", "bin"))
    up = F.array_union(F.array(level), F.filter("levels", lambda k: k > F.col(level)))
    dealt = df.crossJoin(F.broadcast(levels)).withColumn(on, F.explode(up)).drop("levels")
    return dealt.withColumn(bin_, F.explode(F.sequence(bin_of(F.col(start), F.col(on), size), bin_of(F.col(end) - 1, F.col(on), size))))


def _levels(df: DataFrame, level: Column) -> DataFrame:
    return df.agg(F.collect_set(level).alias("levels"))


#: So many neighbours among a bin's features are joined as one row.
RUN = 32


def overlap_join(windows: DataFrame, features: DataFrame, mode: str = "overlap", size: int = 64) -> DataFrame:
    """windows(chrom, start, end, ...) with features(chrom, start, end, ...) that meet them.

    mode 'overlap': the half-open intervals share a base. 'endpoint': the feature's start or end lies in
    [window start, window end], as the reference tests it (features that span the whole window are missed).
    An interval has the level whose bins are as wide as it is long, so that it touches two of them at most; a pair meets on the
    higher of its two levels, in the bin where the later start lies. A row is dealt to its own level and to the higher ones
    that occur on the other side: never more than 2 * LEVELS rows, however long it is, and what meets on a
    level is mostly what overlaps. Empty intervals and rows without a place join nothing. Columns come back as w_* and f_*.

    A bin's features are joined in runs of neighbours, which come out again and again, a window after the other: files of the pairs, whose
    number grows with both tables' density, then take a fraction of the bytes that single features take.
    """
    w = windows.where("end >= start" if mode == "endpoint" else "end > start").select(*(F.col(c).alias(f"w_{c}") for c in windows.columns))
    f = features.select(*(F.col(c).alias(f"f_{c}") for c in features.columns))
    # `before` is the place that must not lie in the window too, since the pair is found there.
    if mode == "overlap":
        f = f.where("f_end > f_start")
        spans = {"x": ("w_start", "w_end"), "y": ("f_start", "f_end")}
        before, apart = F.lit(None).cast("long"), []
    elif mode == "endpoint":
        # Both ends as points; the end counts only where the start lies outside.
        f = f.withColumn("y_last", F.explode(F.array(F.lit(False), F.lit(True))))
        at = "CASE WHEN y_last THEN f_end ELSE f_start END"
        f = f.where(f"{at} IS NOT NULL")
        spans = {"x": ("w_start", "w_end + 1"), "y": (at, f"{at} + 1")}
        before, apart = F.expr("CASE WHEN y_last THEN f_start END"), ["y_last"]
    else:
        raise ValueError(f"mode {mode}")

    def placed(df: DataFrame, side: str) -> DataFrame:
        start, end = map(F.expr, spans[side])
        return df.select("*", start.alias(f"{side}_from"), end.alias(f"{side}_to"), level_of(end - start, size).alias(f"{side}_level"))

    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, side: str, levels: DataFrame, chrom: str) -> DataFrame:
        """Rows in their bins; what follows from their columns is not sent."""
        out = _bins(placed(df, side), side, levels, size).drop(f"{side}_from", f"{side}_to", f"{side}_level")
        return placed(out.repartition(n, chrom, f"{side}_on", f"{side}_bin"), side)

    # Points have the lowest level, so that the features need not be read for theirs.
    levels = windows.sparkSession.range(1).select(F.array(F.lit(0)).alias("levels")) if mode == "endpoint" else _levels(placed(f, "y"), F.col("y_level"))
    dealt_w = dealt(w, "x", levels, "w_chrom").withColumn("x_wide", width_of(F.col("x_on"), size))
    dealt_f = dealt(f, "y", _levels(placed(w, "x"), F.col("x_level")), "f_chrom")
    place = Window.partitionBy("f_chrom", "y_on", "y_bin").orderBy(*apart, "y_level", "y_from", "y_to")
    numbered = dealt_f.withColumn("run", F.floor((F.row_number().over(place) - 1) / RUN))
    bounds = [F.max("y_level").alias("most_level"), F.min("y_from").alias("least_from"), F.max("y_from").alias("most_from"), F.max("y_to").alias("most_to")]
    runs = numbered.groupBy(F.col("f_chrom").alias("y_chrom"), "y_on", "y_bin", "run").agg(F.collect_list(F.struct(*f.columns)).alias("of_run"), *bounds)

    x_from, x_to, x_on, x_bin = (F.col(f"x_{c}") for c in ("from", "to", "on", "bin"))
    bin_with = lambda y: F.floor(F.greatest(x_from, F.col(y)) / F.col("x_wide"))
    same = (F.col("w_chrom") == F.col("y_chrom")) & (x_on == F.col("y_on")) & (x_bin == F.col("y_bin"))
    some = (F.col("least_from") < x_to) & (x_from < F.col("most_to")) & (x_on == F.greatest("x_level", "most_level")) & x_bin.between(bin_with("least_from"), bin_with("most_from"))
    each = (F.col("y_from") < x_to) & (x_from < F.col("y_to")) & (x_on == F.greatest("x_level", "y_level")) & (x_bin == bin_with("y_from"))
    each &= ~F.coalesce(before.between(x_from, x_to - 1), F.lit(False))
    met = placed(runs.join(dealt_w.hint("merge"), same & some).select(*dealt_w.columns, F.inline("of_run")), "y").where(each)
    return met.select(*w.columns, *(f"f_{c}" for c in features.columns))


def overlap_totals(windows: DataFrame, features: DataFrame, keys: list[str], amounts: dict[str, str]) -> DataFrame:
    """keys of features, n, the sums of `amounts` (name -> column of windows) and `first`, the least window start, over all pairs that
    overlap_join(windows, features) has of a key; a key without pairs has no row.

    No pair is made: a feature's windows are those that begin before its end less those that have ended at its start, two running sums over
    both tables' ends in order; and the least start of what ends behind a feature's start is a running minimum. So a feature that
    meets every window costs as much as any other. NULL amounts count as 0.
    """
    w = windows.where("chrom is not null and end > start")
    f = features.where("chrom is not null and end > start")
    added = {"n": F.lit(1).cast("long"), **{a: F.coalesce(F.col(c), F.lit(0)) for a, c in amounts.items()}}
    none = [F.lit(0).alias(a) for a in added]
    value = [x.alias(a) for a, x in added.items()]
    of_key = F.struct(*keys).alias("key")
    kind = f.select(of_key).schema["key"].dataType
    nobody = F.lit(None).cast(kind).alias("key")
    # Ends at a place come before the features' questions, starts behind them: half-open intervals that touch do not meet.
    side = lambda df, at, tie, sign, key, what: df.select("chrom", F.col(at).alias("at"), F.lit(tie).alias("tie"), F.lit(sign).alias("sign"), key, *what)
    events = side(w, "end", 0, -1, nobody, value).union(side(f, "start", 1, -1, of_key, none)).union(side(f, "end", 1, 1, of_key, none)).union(side(w, "start", 2, 1, nobody, value))
    of = lambda sign: {f"{a}_{sign}": F.when(F.col("sign") == sign, F.col(a)).otherwise(0) for a in added}
    counted = running(events, ["chrom"], "at", {**of(1), **of(-1)}, ("tie",)).where("key is not null")
    asked = [F.when(F.col("sign") == 1, F.col(f"{a}_1")).otherwise(-F.col(f"{a}_-1")).alias(a) for a in added]
    sums = counted.select("key", *asked).groupBy("key").agg(*(F.sum(a).alias(a) for a in added)).where("n > 0")
    # From the right: a feature's question comes before the windows that end where it starts.
    ends = w.select("chrom", (-F.col("end")).alias("at"), F.lit(1).alias("tie"), F.col("start"), nobody, F.lit(None).cast("long").alias("stop"))
    ends = ends.union(f.select("chrom", -F.col("start"), F.lit(0), F.lit(None), of_key, "end"))
    least = running(ends, ["chrom"], "at", {"first": F.col("start")}, ("tie",), F.min).where("key is not null and first < stop")
    found = sums.join(least.groupBy("key").agg(F.min("first").alias("first")), "key")
    return found.select(*(F.col(f"key.{c}").alias(c) for c in keys), *added, "first")


#: Hash values that stand for the tiles that are needed; their set, which is broadcast, is never larger.
TILE_HASHES = 1 << 20


def fetch_windows(windows: DataFrame, tiles: DataFrame, tile_size: int, strand: str | None = None) -> DataFrame:
    """Every row of windows(chrom, start, end, ...), all its columns kept, with `seq` from tiles(chrom, tile_idx, seq), upper case.

    What lies left of 0, right of the reference or in a tile that is missing is N. With `strand`, the name of a column of
    windows, rows whose strand is '-' get the reverse complement. Repeated rows have a row each; an interval without bases gives '',
    one without chrom, start or end NULL; a column `seq` of windows is replaced.

    Each distinct interval is fetched once and joined back, so that a window that stands in very many rows costs one fetch, and
    Spark can split that join where its rows are many. Of the tiles only those go to the shuffle whose hash is
    among those of the tiles that are needed. Only intervals over several tiles are put together from pieces.
    """
    first = f"floor(greatest(start, 0) / {tile_size})"
    last = f"greatest(floor((end - 1) / {tile_size}), {first})"
    span = windows.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("chrom is not null and end > start").distinct()
    need = span.withColumn("several", F.expr(f"{first} < {last}")).withColumn("tile_idx", F.explode(F.expr(f"sequence({first}, {last})")))
    mark = F.pmod(F.xxhash64("chrom", "tile_idx"), F.lit(TILE_HASHES)).alias("mark")
    seqs = tiles.select("chrom", F.col("tile_idx").cast("long").alias("tile_idx"), F.col("seq").alias("tile_seq"))
    seqs = seqs.withColumn("mark", mark).join(F.broadcast(need.select(mark).distinct()), "mark", "left_semi").drop("mark")
    lo = F.greatest(F.col("start") - F.col("tile_idx") * tile_size, F.lit(0)).cast("int")
    hi = F.least(F.col("end") - F.col("tile_idx") * tile_size, F.lit(tile_size)).cast("int")
    size = F.greatest(hi - lo, F.lit(0))
    piece = F.rpad(F.coalesce(F.substring("tile_seq", lo + 1, size), F.lit("")), size, "N")
    hits = need.join(seqs, ["chrom", "tile_idx"], "left").select("chrom", "start", "end", "several", "tile_idx", piece.alias("p"))
    key = ["chrom", "start", "end"]
    within = hits.where("not several").select(*key, F.col("p").alias("seq"))
    across = hits.where("several").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("tile_idx", "p"))).alias("ps"))
    fetched = within.union(across.select(*key, F.array_join(F.transform("ps", lambda e: e["p"]), "").alias("seq")))
    whole = pad_with_n(F.upper("seq"), F.col("start"), (F.col("end") - F.col("start")).cast("int"))
    fetched = fetched.select(*(F.col(c).alias(f"{c}_of_") for c in key), whole.alias("seq_of_"))
    seq = F.when(F.col("end") <= F.col("start"), F.lit("")).otherwise(F.col("seq_of_"))
    out = windows.join(fetched, [F.col(c) == F.col(f"{c}_of_") for c in key], "left")
    seq = strand_sequence(seq, F.col(strand)) if strand else seq
    return out.select(*(c for c in windows.columns if c.lower() != "seq"), seq.alias("seq"))


def pad_with_n(seq: Column, start: Column, length: Column) -> Column:
    """Ns for the part of a window left of 0, then Ns on the right to the window's length."""
    return F.rpad(F.concat(F.repeat(F.lit("N"), F.greatest(-start, F.lit(0)).cast("int")), seq), length, "N")


def natural_key(name: Column) -> tuple[Column, Column, Column]:
    """Sort key of names in natural order: text before the number, the number, the whole name."""
    return F.regexp_extract(name, r"^(\D*)", 1), F.coalesce(F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).cast("long"), F.lit(-1)), name


def natural_index(df: DataFrame, name: str, out: str = "idx") -> DataFrame:
    """Distinct names with their 0-based place in natural order; for small sets such as files and heads."""
    names = df.select(name).distinct()
    return names.withColumn(out, (F.row_number().over(Window.orderBy(*natural_key(F.col(name)))) - 1).cast("int"))
