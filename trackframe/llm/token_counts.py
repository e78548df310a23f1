"""Exact token totals for every context limit from one histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import materialize, row_groups, text_bytes
from trackframe.llm.tokenizer_cache import ByteLevelEncoder, loaded

#: Lengths a suffix sum window holds; totals of these spans are summed apart.
SPAN = 256


def encoded_lengths(docs: DataFrame, path: str, *more: str) -> DataFrame:
    """Each row of docs as (doc_id, n_tokens, *more): ids of the whole text (null: empty), no end id."""

    def run(batches):
        import pyarrow as pa

        enc = loaded(ByteLevelEncoder, path)
        for rows in row_groups(batches, 8_000_000, lambda r: len(r[1])):
            doc, texts, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(enc.count_many(texts)), *(pa.array(c, pa.string()) for c in rest)], ["doc_id", "n_tokens", *more])

    return text_bytes(docs, *(F.col(c).cast("string").alias(c) for c in more)).mapInArrow(run, "doc_id long, n_tokens long" + "".join(f", `{c}` string" for c in more))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row for each length that occurs; summed before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram, what a context limit of L keeps.

    n_docs of length L; docs_longer, tokens_longer: documents above L and their tokens; docs_upto: at
    most L (its share of all documents is the quantile of L); tokens_truncated: all documents cut at L;
    tokens_total. Suffix sums run inside spans of 256 lengths, on top of the spans' own totals, so that no
    task holds the whole histogram's rows. A limit between two lengths L < M truncates to
    tokens_truncated(L) + (limit - L) * docs_longer(L). An empty histogram gives no rows.
    """
    h = histogram.withColumn("span", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("span")
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    spans = spans.select("span", zero(F.sum("d").over(above)).alias("d_above"), zero(F.sum("t").over(above)).alias("t_above"), F.sum("d").over(all_).alias("docs_total"), F.sum("t").over(all_).alias("tokens_total"))
    inside = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(spans, "span").withColumn("docs_longer", zero(F.sum("n_docs").over(inside)) + F.col("d_above")).withColumn("tokens_longer", zero(F.sum("tokens").over(inside)) + F.col("t_above"))
    return out.select(
        "n_tokens", "n_docs", (F.col("docs_total") - F.col("docs_longer")).alias("docs_upto"), "docs_longer", "tokens_longer",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_truncated"), "docs_total", "tokens_total",
    )


def quantile(totals: DataFrame, share: float) -> DataFrame:
    """One row, n_tokens: the least length that at least this share of all documents stay within; NULL of no documents."""
    return totals.where(F.col("docs_upto") >= F.lit(float(share)) * F.col("docs_total")).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """One row, tokens: of all documents cut at `limit`, whatever the limit; NULL of no documents.

    The greatest length up to the limit tells; with none, every document gives `limit` ids.
    """
    own = F.struct("n_tokens", (F.col("tokens_truncated") + (F.lit(limit) - F.col("n_tokens")) * F.col("docs_longer")).alias("tokens"))
    return totals.agg(F.coalesce(F.max(F.when(F.col("n_tokens") <= limit, own))["tokens"], F.max("docs_total") * F.lit(limit)).cast("long").alias("tokens"))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """context_totals of every row of docs (null text: length 0; repeated rows count each time).

    Texts of any length are encoded whole; other columns are ignored; an empty table gives none. The
    histogram, a row a length, is written to the shared folder, since its sums are taken in two steps.
    """
    return context_totals(materialize(length_histogram(encoded_lengths(docs, path)), "lengths"))
