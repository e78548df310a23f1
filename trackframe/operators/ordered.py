"""Exact quantiles, running sums and ranks in the order of a number, without a task that holds a key.

Numbers are laid into cells, coarse and fine, by a function that never decreases: the logarithm of the magnitude, with the
sign. Counts by cell are summed before the shuffle; running sums over the coarse cells of a key, some thousands at most, and
over the fine cells of a coarse one tell where a cell begins. Only inside a fine cell are values themselves put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coarse cells for each doubling of a magnitude; fine cells in a coarse one; magnitudes below 2 ** -SMALLEST are told apart by fine cells only.
COARSE, FINE, SMALLEST = 64, 4096, 60
#: Cells of NULL, which comes first, and of NaN, which comes last.
NULL_CELL, NAN_CELL = -(1 << 40), 1 << 40


def _height(x: Column) -> Column:
    x = x.cast("double")
    return F.signum(x) * F.least(F.log2(1 + F.abs(x) * F.lit(float(1 << SMALLEST))), F.lit(1200.0))


def cells(x: Column) -> tuple[Column, Column]:
    """(coarse, fine) cell of a number: x <= y gives coarse(x) <= coarse(y), and fine(x) <= fine(y) where those are equal."""
    at = F.floor(_height(x) * (COARSE * FINE))
    # Never NULL to the optimizer either: a filter that it infers from a join would keep equal parts of a plan from being computed once.
    odd = lambda c: F.coalesce(F.when(F.isnan(x.cast("double")), F.lit(NAN_CELL)).otherwise(c), F.lit(NULL_CELL))
    return odd(F.floor(at / FINE)), odd(F.pmod(at, F.lit(FINE)))


def _key(keys: list[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _before(*by: str, order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(k, x, c, f, n): the distinct values of each key, their cells and how often each occurs; NULL is left out."""
    x = F.col(value).cast("double")
    some = df.where(x.isNotNull()).select(_key(keys).alias("k"), x.alias("x")).groupBy("k", "x").agg(F.count("*").alias("n"))
    c, f = cells(F.col("x"))
    return some.select("k", "x", c.alias("c"), f.alias("f"), "n")


def _narrowed(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Cells of (by..., cell, n, base, ranks, facts) that hold one of the ranks, with their own first number and ranks."""
    first = (F.col("base") + F.coalesce(F.sum("n").over(_before(*by, order=cell)), F.lit(0))).alias("first")
    own = F.filter("ranks", lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n")))
    return counts.select("*", first).withColumn("ranks", own).where(F.size("ranks") > 0).select(*by, cell, F.col("first").alias("base"), "ranks", "facts")


def _quantiles(values: DataFrame, shares: list[float]) -> DataFrame:
    """(k, n, mean, q) of counted_values; a key's number of values and mean (`facts`) travel with the cells that are looked into."""
    whole = Window.partitionBy("k")
    total = F.col("facts.total")
    place = lambda p: F.lit(float(p)) * (total - 1)
    ranks = F.array_distinct(F.array(*(to(place(p)).cast("long") for p in shares for to in (F.floor, F.ceil))))
    facts = F.struct(F.sum("n").over(whole).alias("total"), (F.sum("s").over(whole) / F.sum("n").over(whole)).alias("mean"))
    coarse = values.groupBy("k", "c").agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s")).withColumn("facts", facts).withColumn("ranks", ranks).withColumn("base", F.lit(0).cast("long"))
    wanted = _narrowed(coarse, ["k"], "c")
    fine = values.join(wanted, ["k", "c"]).groupBy("k", "c", "f", "base", "ranks", "facts").agg(F.sum("n").alias("n"))
    wanted = _narrowed(fine, ["k", "c"], "f")
    found = _narrowed(values.join(wanted, ["k", "c", "f"]), ["k", "c", "f"], "x").select("k", "x", "facts", F.explode("ranks").alias("rank"))
    at = found.groupBy("k").agg(F.first("facts").alias("facts"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    value = lambda p, to: F.col("at")[to(place(p)).cast("long")]
    # Between two ranks in proportion; equal neighbours, infinite ones too, are taken as they are.
    between = lambda p: F.when(value(p, F.floor) == value(p, F.ceil), value(p, F.floor)).otherwise(value(p, F.floor) + (place(p) - F.floor(place(p))) * (value(p, F.ceil) - value(p, F.floor)))
    return at.select("k", total.alias("n"), F.col("facts.mean").alias("mean"), F.array(*map(between, shares)).alias("q"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n and q, the exact continuous quantiles of `value` for each share, as percentile() gives them.

    Counts by coarse cell find the cells that hold the ranks asked for; their fine cells, and at last the values of
    those, narrow them down. Equal values are counted as one before the first shuffle, which deals out distinct values;
    what one task puts in order is a fine cell: of 2 ** -18 of a doubling of the magnitude. NULL is left out, NaN is the greatest value.
    A key without values has no row.
    """
    return _quantiles(counted_values(df, keys, value), shares).select(*(F.col(f"k.{_quoted(c)}").alias(c) for c in keys), "n", "q")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def box_stats(df: DataFrame, keys: list[str], value: str, whiskers: float = 1.5) -> DataFrame:
    """keys, q1, median, q3, mean, low, high: quartiles, and the outermost values within `whiskers` interquartile ranges of the box.

    Whole cells between the whiskers' ends give their least and greatest value; only in the two cells of the ends are values looked at.
    """
    values = counted_values(df, keys, value)
    box = _quantiles(values, [0.25, 0.5, 0.75]).select("k", "mean", *(F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))))
    reach = F.lit(float(whiskers)) * (F.col("q3") - F.col("q1"))
    box = box.withColumn("from", F.col("q1") - reach).withColumn("to", F.col("q3") + reach)
    box = box.withColumn("c_from", cells(F.col("from"))[0]).withColumn("c_to", cells(F.col("to"))[0])
    held = values.groupBy("k", "c").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    inside = held.join(box, "k").where((F.col("c") > F.col("c_from")) & (F.col("c") < F.col("c_to"))).select("k", "low", "high")
    ends = box.select("k", "from", "to", F.explode(F.array_distinct(F.array("c_from", "c_to"))).alias("c"))
    edge = values.join(ends, ["k", "c"]).where(F.col("x").between(F.col("from"), F.col("to"))).groupBy("k", "c").agg(F.min("x").alias("low"), F.max("x").alias("high")).drop("c")
    outer = inside.union(edge).groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return box.join(outer, "k").select(*(F.col(f"k.{_quoted(c)}").alias(c) for c in keys), "q1", "median", "q3", "mean", "low", "high")


def running(df: DataFrame, parts: list[str], order: str, amounts: dict[str, Column], ties: tuple[str, ...] = (), how=F.sum) -> DataFrame:
    """Adds a column for each of `amounts`: its sum (or minimum, with how=F.min; NULL of none) over the rows of the same parts up to and with
    this one, by the number `order`, then by `ties`; NULL comes first. Rows equal in all of these come in any order.

    Rows whose number is the same stand in one task; all else is dealt out by cells.
    """
    free = "sum_"  # before the names of helper columns, so that none clashes with one of df
    while any(c.lower().startswith(free) for c in df.columns):
        free = "_" + free
    k, c, f = (f"{free}{x}" for x in "kcf")
    add, own, first, part_first = ({name: f"{free}{x}{i}" for i, name in enumerate(amounts)} for x in ("add", "own", "first", "part"))
    coarse, fine = cells(F.col(order))
    marked = df.select("*", _key(parts).alias(k), coarse.alias(c), fine.alias(f), *(x.alias(add[n]) for n, x in amounts.items()))
    sums = [how(add[n]).alias(own[n]) for n in amounts]
    counts = marked.groupBy(k, c, f).agg(*sums)
    before = lambda of, *by, order: [how(own[n]).over(_before(*by, order=order)).alias(of[n]) for n in amounts]
    starts = counts.groupBy(k, c).agg(*(how(own[n]).alias(own[n]) for n in amounts)).select(k, c, *before(part_first, k, order=c))
    firsts = counts.select(k, c, f, *before(first, k, c, order=f)).join(starts, [k, c])
    upto = Window.partitionBy(k, c, f).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.select("*", *(how(add[n]).over(upto).alias(own[n]) for n in amounts)).join(firsts, [k, c, f])
    zero = lambda x: F.coalesce(x, F.lit(0))
    whole = lambda n: F.least(own[n], first[n], part_first[n]) if how is F.min else F.col(own[n]) + zero(F.col(first[n])) + zero(F.col(part_first[n]))
    return out.select(*df.columns, *(whole(n).alias(n) for n in amounts))


def running_sum(df: DataFrame, parts: list[str], order: str, name: str, amount: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `name`: the sum of `amount` (1: a rank) up to and with each row; see `running`."""
    return running(df, parts, order, {name: F.lit(1).cast("long") if amount is None else amount}, ties)


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds the rank of `value` inside the keys, ties sharing the mean of their ranks; NULL has none and counts for none.

    Distinct values are ranked by their counts, so neither a large key nor a value that very many rows share is one task's;
    the ranks are joined back by key and value, a join that Spark can split.
    """
    at = "rank_of_"
    while any(c.lower().startswith(at) for c in df.columns):
        at = "_" + at
    ranked = running_sum(counted_values(df, keys, value), ["k"], "x", "upto", F.col("n"))
    ranked = ranked.select(F.col("k").alias(f"{at}k"), F.col("x").alias(f"{at}x"), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"{at}rank"))
    marked = df.withColumn(f"{at}key", _key(keys))
    met = marked.join(ranked, (F.col(f"{at}key") == F.col(f"{at}k")) & (F.col(value).cast("double") == F.col(f"{at}x")), "left")
    return met.select(*df.columns, F.col(f"{at}rank").alias(out))
