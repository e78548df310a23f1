"""What the operators of this subpackage share: reading, shared tables, rows in Arrow batches, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
#: By byte: ASCII letters; ASCII marks but the apostrophe, which begins contractions.
LETTERS = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
MARKS = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where a session on one machine names none (tests), a folder of that machine is set; on a cluster that is an error.
    """
    at = spark.conf.get(CHECKPOINT, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"the session names no shared folder in {CHECKPOINT}")
        at = "file:///tmp/trackframe-shared"
        spark.conf.set(CHECKPOINT, at)
    return at.rstrip("/")


def quoted(name: str) -> str:
    """A column's name as it is, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, df: DataFrame) -> str:
    """A name that begins like `name` and with which no column of df begins, in whatever case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


#: Folders written while a list is here (see `last_stays`).
_WRITTEN: list[list[str]] = []


def _folder(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def last_stays(spark: SparkSession):
    """Of the tables that are materialized inside, only the last, the result, is left at the end; what it was made of goes."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for at in _WRITTEN.pop()[:-1]:
            path, store = _folder(spark, at)
            store.delete(path, True)


def for_the_session(spark: SparkSession, at: str) -> None:
    """Have a folder that was written go when the driver ends."""
    path, store = _folder(spark, at)
    store.deleteOnExit(path)
    if _WRITTEN:
        _WRITTEN[-1].append(at)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives a lost executor.

    The table goes with the session.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/trackframe/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    for_the_session(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def text_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text (null: empty), with no other column of the input unless named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *more)


def row_groups(batches, bound: int, size):
    """Cut the rows of Arrow batches into lists whose sizes sum to about `bound`, so that memory stays bounded."""
    rows, total = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            total += size(row)
            if total >= bound:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def distinct_pieces(marked: list[bytes], marks: bool = False, skip: int = 0) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Cut buffers before every space (each must begin with one) and, with `marks`, between a letter and a mark.

    Returns the distinct pieces (their space included, but for `skip`), the piece numbers in order, and the pieces of each buffer.
    """
    import pyarrow as pa

    big = b"".join(marked)
    raw = np.frombuffer(big, np.uint8)
    cut = raw == 32
    if marks:
        cut[1:] |= LETTERS[raw[:-1]] & MARKS[raw[1:]]
    at = np.flatnonzero(cut)
    cuts = np.append(at, len(big))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(big)]).dictionary_encode()
    ends = np.searchsorted(at, np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked))))
    own, cuts = pieces.dictionary, np.frombuffer(pieces.dictionary.buffers()[1], np.int64, len(pieces.dictionary) + 1).tolist()
    raw = own.buffers()[2].to_pybytes()
    return [raw[a + skip : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pieces.indices.to_numpy(), np.diff(ends, prepend=0)


#: Byte table: what separates words, as a space.
AS_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
END_WORD = b" \xfc"  # no UTF-8 text holds it


def distinct_words(texts: list[bytes], end: bool = False, table: bytes = AS_SPACE) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts: the distinct ones, their numbers in text order, the words of each text.

    With `end` a text has one more word, b"", behind its last. Another byte table gives other words: what stands
    between spaces once it is applied.
    """
    after = END_WORD if end else b""
    words, index, counts = distinct_pieces([b" " + t.translate(table) + after for t in texts], skip=1)
    if b"" in words:  # what stands between two spaces
        stay = index != words.index(b"")
        index, counts = index[stay], sums_of(stay.astype(np.int64), counts)
    if end and texts:
        words[words.index(END_WORD[1:])] = b""
    return words, index, counts


def take_runs(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values holds runs of these sizes; the runs that index names, one behind the other."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[index]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - ends + n, n)]


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] values, of the next counts[1] values, ...; each depends on its own values only."""
    out, has = np.zeros(len(counts), values.dtype), counts > 0
    if has.any():
        out[has] = np.add.reduceat(values, (np.cumsum(counts) - counts)[has])
    return out


class TwoGenerations(dict):
    """A cache of at most 2 * `most` entries: a full young generation becomes the old one."""

    def __init__(self, most: int, make=None):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Call between groups of rows, never while a group still reads from the cache."""
        if len(self) > self.most:
            self.old = self.copy()
            self.clear()


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b (numpy, one task's block)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label.copy())  # the node that a node pointed to gets its better label
        label = label[label]
        if (label == before).all():
            break
    return label


def stream_groups(batches, keys: list[str], most: int):
    """Whole key groups of rows sorted by `keys`, gathered into pyarrow tables of about `most` rows.

    Yields (table, starts): the row at which each group starts, with the end appended. The last group
    of a gathered table waits for the next rows; memory is `most` rows plus the largest group.
    """
    import pyarrow as pa

    held, n = [], 0

    def cut(t: pa.Table):
        change = np.zeros(len(t), bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            starts = cut(t)
            if len(starts) > 1:
                end = int(starts[-1])
                yield t.slice(0, end), starts
                t = t.slice(end).combine_chunks()
            held, n = t.to_batches(), len(t)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(cut(t), len(t))


def tiles(df: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """Deal the groups of `keys` so that every pair of a group meets somewhere and no large group is one task's.

    A group of more than `most` rows has ceil(n / most) chunks by the hash of `by`; each pair of chunks is a
    tile (tile_a, tile_b). Adds those and `chunk` (all 0 in other groups). Rows are dealt and sorted by tile. Only
    the keys are shuffled to find the large groups, whose list is broadcast after a check of its size.
    """
    large = materialize(df.groupBy(*keys).agg(F.count("*").alias("in_group")).where(F.col("in_group") > most), "large")
    if n_large := large.count():
        df = df.join(F.broadcast(large) if n_large <= 100_000 else large, keys, "left")
    else:
        df = df.withColumn("in_group", F.lit(None).cast("long"))
    dealt = (
        df.withColumn("chunks", F.coalesce(F.ceil(F.col("in_group") / F.lit(most)), F.lit(1)).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .withColumn("tile_a", F.least("chunk", "other"))
        .withColumn("tile_b", F.greatest("chunk", "other"))
        .drop("in_group", "chunks", "other")
    )
    tile = [*keys, "tile_a", "tile_b"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *tile).sortWithinPartitions(*tile)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of `edges` (a, b: long): the smallest node it reaches.

    Alternates large-star and small-star steps until the links form stars. Each step uses a minimum by
    node, which is summed before the shuffle, and a join that can be split when a node has very many
    links. Every round is written to the shared folder; the driver sees two numbers a round.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = sign(edges)
    for _ in range(rounds):
        if not last[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        edges = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(low, "a")
        down = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(down.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = sign(edges)
        if tuple(now) == tuple(last):
            break
        last = now
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())
