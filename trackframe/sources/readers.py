"""Readers with explicit schemas; nothing is inferred from data but the columns of wide sheets."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators.dist import natural_index
from trackframe.operators.experiments import parse_epoch_lines


def file_name() -> F.Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def source_name() -> F.Column:
    """The name of the file a row is from, or of the folder whose part files Spark wrote."""
    return F.element_at(F.split(F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*part-[^/]*$", ""), "/"), -1)


def check_tracks(named: DataFrame) -> None:
    """An error that names tracks of named(track, gene_idx) whose genes are not those of the first, by their number and a hash of the set."""
    each = named.groupBy("track").agg(F.count("*").alias("n"), F.sum(F.xxhash64("gene_idx").cast("decimal(38,0)")).alias("h"))
    kinds = each.groupBy("n", "h").agg(F.count("*").alias("tracks"), F.sort_array(F.slice(F.sort_array(F.collect_list("track")), 1, 5)).alias("some")).orderBy(F.desc("tracks"), "some").limit(5).collect()
    if len(kinds) > 1:
        told = "; ".join(f"{k['tracks']} with {k['n']} genes ({', '.join(k['some'])})" for k in kinds)
        raise ValueError(f"tracks do not hold the same genes: {told}")


def scan_tracks(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(track_idx, gene_idx, bins) of a folder with one Parquet file or folder a track, numbered in natural order of names.

    Rows: gene_idx long, bins array<float>. A name is what follows `path` in the file's own. Unless `check` is off, tracks that do not hold the
    same genes are an error; the check reads the genes' column alone.
    """
    raw = spark.read.schema("gene_idx long, bins array<float>").option("recursiveFileLookup", True).parquet(path)
    named = raw.select("gene_idx", "bins", source_name().alias("track"))
    if check:
        check_tracks(named.select("track", "gene_idx"))
    return named.join(natural_index(named, "track", "track_idx"), "track").select("track_idx", "gene_idx", "bins")


def detect_dimensions(tracks: DataFrame) -> DataFrame:
    """One row: genes, bins, tracks, and whether every track has all genes and bins."""
    each = tracks.groupBy("track_idx").agg(F.countDistinct("gene_idx").alias("g"), F.min(F.size("bins")).alias("lo"), F.max(F.size("bins")).alias("hi"))
    return each.agg(F.max("g").alias("num_genes"), F.max("hi").alias("num_bins"), F.count("*").alias("num_tracks"), ((F.min("g") == F.max("g")) & (F.min("lo") == F.max("hi"))).alias("agree"))


def split_sheet(sheet: DataFrame, index: str, n_meta: int = 7) -> tuple[DataFrame, DataFrame]:
    """A wide sheet as metadata and long labels (gene_idx, target_idx, target_name, y_true); the index is a column."""
    cols = [c for c in sheet.columns if c != index]
    meta, labels = cols[:n_meta], cols[n_meta:]
    places = F.create_map(*(F.lit(x) for i, c in enumerate(labels) for x in (c, i)))
    long = sheet.unpivot([index], labels, "target_name", "y_true")
    return sheet.select(F.col(index).alias("gene_idx"), *meta), long.select(F.col(index).alias("gene_idx"), F.element_at(places, F.col("target_name")).alias("target_idx"), "target_name", F.col("y_true").cast("double").alias("y_true"))


def scan_expression_sheet(spark: SparkSession, path: str, index: str, n_meta: int = 7, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """split_sheet of a delimited sheet with a header line, whose names the label columns' targets get."""
    sheet = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return split_sheet(sheet.withColumn(index, F.col(index).cast("long")), index, n_meta)


def extract_label_columns(df: DataFrame, first: int = 7) -> DataFrame:
    return df.select(df.columns[first:])


def scan_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def scan_targets(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """The targets' table; an error if the chosen split has no row."""
    df = scan_tsv(spark, path, schema)
    if split is not None:
        df = df.where(F.col("split") == split)
        if df.isEmpty():
            raise ValueError(f"no rows in split {split}")
    return df


def parse_bed(lines: DataFrame, column: str = "value") -> DataFrame:
    """chrom, start, end, strand of white-space separated lines; numbers such as 1e3 are allowed; no strand is +."""
    a = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    whole = lambda k: F.floor(F.get(a, F.lit(k)).cast("double")).cast("long")
    return lines.where(F.length(F.trim(column)) > 0).select(F.get(a, F.lit(0)).alias("chrom"), whole(1).alias("start"), whole(2).alias("end"), F.when(F.size(a) >= 6, F.get(a, F.lit(5))).otherwise("+").alias("strand"))


def scan_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def scan_sequences_bed(spark: SparkSession, path: str, split: str, expected: int | None = None) -> DataFrame:
    """Windows of a split; an error if their number is not the expected one."""
    df = spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, split string").where(F.col("split") == split)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} windows for {expected} predictions")
    return df


def parse_gff3(rows: DataFrame, features: list[str]) -> DataFrame:
    """chrom, start (0-based), end, strand, feature, gene_name of GFF3 columns c0..c8, for the chosen feature types."""
    attrs = F.str_to_map("c8", F.lit(";"), F.lit("="))
    return rows.where(F.col("c2").isin(features)).select(F.col("c0").alias("chrom"), (F.col("c3").cast("long") - 1).alias("start"), F.col("c4").cast("long").alias("end"), F.col("c6").alias("strand"), F.col("c2").alias("feature"), F.element_at(attrs, F.lit("gene_name")).alias("gene_name"))


def scan_gff3(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    return parse_gff3(spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"c{i} string" for i in range(9))), features)


def reference_tiles(seqs: DataFrame, size: int) -> DataFrame:
    """(chrom, tile_idx, seq) of whole sequences (chrom, seq)."""
    at = seqs.where(F.length("seq") > 0).select("chrom", "seq", F.explode(F.expr(f"sequence(0L, floor((length(seq) - 1) / {size}))")).alias("tile_idx"))
    return at.select("chrom", "tile_idx", F.expr(f"substring(seq, cast(tile_idx * {size} as int) + 1, {size})").alias("seq"))


def scan_epoch_logs(spark: SparkSession, path: str) -> DataFrame:
    """Epoch rows of all logs of a folder; the run is the name of the file, <run>.log, or of its folder, run=<run>."""
    run = F.regexp_replace(F.regexp_replace(source_name(), r"\.log$", ""), "^run=", "")
    return parse_epoch_lines(spark.read.option("recursiveFileLookup", True).text(path).select("value", run.alias("run")))


def scan_shards(spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Examples of a split (partition pruning), some columns only (column pruning), or the files of a pattern."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    df = reader.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select(*columns) if columns else df


def keyed_matrix(df: DataFrame) -> DataFrame:
    """(id, features) of (row_idx, id binary or string, features); the last row of an id wins."""
    name = F.decode("id", "UTF-8") if dict(df.dtypes)["id"] == "binary" else F.col("id")
    return df.withColumn("id", name).groupBy("id").agg(F.max_by("features", "row_idx").alias("features"))


def scan_keyed_matrix(spark: SparkSession, path: str) -> DataFrame:
    """keyed_matrix of the Parquet files of a folder: row_idx long, id binary, features array<double>."""
    return keyed_matrix(spark.read.schema("row_idx long, id binary, features array<double>").parquet(path))


def scan_feature_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of write_feature_shards, of one split if given: gene_idx, features [bins][tracks], targets, shard, split; an error where the shapes are
    not those that the schema file tells."""
    shape = spark.read.schema("num_bins int, num_tracks int, num_targets int").json(f"{path}/_shape").first()
    rows = scan_shards(spark, f"{path}/shards", split)
    sound = (F.size("features") == shape["num_bins"]) & F.forall("features", lambda r: F.size(r) == shape["num_tracks"]) & (F.size("targets") == shape["num_targets"])
    told = F.concat(F.lit(f"not {shape['num_bins']} bins of {shape['num_tracks']} tracks and {shape['num_targets']} targets: gene "), F.col("gene_idx").cast("string"))
    return rows.withColumn("features", F.when(sound, F.col("features")).otherwise(F.raise_error(told)))


def prediction_table(wide: DataFrame, gene: str = "geneID") -> DataFrame:
    """(gene_id, tissue, y_pred) of a wide table with several rows a gene."""
    return wide.unpivot([gene], [c for c in wide.columns if c != gene], "tissue", "y_pred").withColumnRenamed(gene, "gene_id")


def first_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The rows of the first n files of a Parquet folder, by name; the folder is listed, not read, to find them."""
    df = spark.read.parquet(path)
    names = sorted({unquote(f).rsplit("/", 1)[-1] for f in df.inputFiles()})[:n]
    return df.where(F.col("_metadata.file_name").isin(names))


def first_values(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """(column, first): the values of the first n rows by `order`, as text joined by ', '; of arrays their first n elements."""
    text = lambda c, k: F.concat(F.lit("["), F.array_join(F.transform(F.slice(c, 1, n), lambda x: F.round(x, 4).cast("string")), " "), F.lit("]")) if k.startswith("array") else F.col(c).cast("string")
    rows = df.orderBy(order).limit(n).select(F.struct(F.col(order).alias("o_"), *(text(c, k).alias(f"c{i}") for i, (c, k) in enumerate(df.dtypes))).alias("row"))
    each = rows.agg(F.sort_array(F.collect_list("row")).alias("rows"))
    joined = lambda i: F.array_join(F.transform("rows", lambda r: F.coalesce(r[f"c{i}"], F.lit("NULL"))), ", ")
    one = F.array(*(F.struct(F.lit(c).alias("column"), joined(i).alias("first")) for i, c in enumerate(df.columns)))
    return each.select(F.explode(one).alias("x")).select("x.*")


def profile_table(df: DataFrame) -> DataFrame:
    """(column, kind, rows, non_null, min_size, max_size, id_like) of every column; sizes of arrays and strings."""
    size = lambda c, k: F.size(c) if k.startswith("array") else F.length(F.col(c).cast("string"))
    facts = df.agg(F.count("*").alias("rows"), *(x for i, (c, k) in enumerate(df.dtypes) for x in (F.count(c).alias(f"n{i}"), F.min(size(c, k)).alias(f"lo{i}"), F.max(size(c, k)).alias(f"hi{i}"))))
    one = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col("rows"), F.col(f"n{i}").alias("non_null"), F.col(f"lo{i}").cast("long").alias("min_size"), F.col(f"hi{i}").cast("long").alias("max_size"), F.lit("id" in c.lower() or "gene" in c.lower()).alias("id_like")) for i, (c, k) in enumerate(df.dtypes)))
    return facts.select(F.explode(one).alias("x")).select("x.*")
