"""Token ids in files: ids ranked by frequency, in byte-aligned variable-length coding.

A file is a Parquet container whose rows are blocks. A block holds the ids of consecutive documents:

* part, block: place of the block; blocks in (part, block) order hold the documents in ascending doc_id order
* doc_ids: array of the block's documents; lengths: ids of each, the end id included
* control: for every id, two bits with its number of bytes less one, four ids a byte, lowest bits first
* data: the rank of every id in that many bytes, little-endian

Rank 0 is the most frequent id of the corpus, so that most ids take one byte. The ranks' table is beside
the blocks (rank, id). The control bytes stand apart from the data, so that numpy finds every id's place by a
table lookup of control bytes and one running sum.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.llm.common import for_the_session, materialize, row_groups, shared_dir, text_bytes
from trackframe.llm.tokenizer_cache import ByteLevelEncoder, loaded

#: By control byte: the sizes of its four ids.
SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
BLOCK = "part long, block long, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned ranks below 2**32."""
    raw = ranks.astype("<u4")
    more = (raw > 0xFF).astype(np.uint8) + (raw > 0xFFFF) + (raw > 0xFFFFFF)
    padded = np.zeros(-(-len(raw) // 4) * 4, np.uint8)
    padded[: len(raw)] = more
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), raw.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data + bytes(4), np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = sizes > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids) of every row of docs: its n ids, the end id included, as little-endian unsigned integers of one width."""

    def run(batches):
        import pyarrow as pa

        enc = loaded(ByteLevelEncoder, path)
        for rows in row_groups(batches, 8_000_000, lambda r: len(r[1])):
            ids, n = enc.encode_many([t for _, t in rows], end_id)
            ends = np.r_[0, np.cumsum(n)] * enc.kind.itemsize
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(n), raw], ["doc_id", "n", "ids"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, n long, ids binary")


def ids_of(rows: list[tuple]) -> np.ndarray:
    """The ids of rows (n, ids) of `encoded`, one behind the other."""
    n, raw = sum(r[0] for r in rows), b"".join(r[1] for r in rows)
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, "<u2")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over every row of encoded(...); a row an id and task is shuffled."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for rows in row_groups(batches, 8_000_000, lambda r: len(r[1])):
            seen = np.bincount(ids_of(rows), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        if len(at := np.flatnonzero(total)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0, block_bytes: int = 4_000_000) -> None:
    """Write every row's ids (null text: none) and the end id to `out`/blocks and `out`/ranks.

    Each text is encoded once; its ids are written to the shared folder, ranked over the corpus and dealt by
    ranges of doc_id (null first; equal ids in either order), so files are even whatever the sources' sizes. The
    vocabulary, of fixed size, is all that passes through the driver. Spark's writer commits each file, so that a
    lost executor leaves no half of one.
    """
    spark = docs.sparkSession
    tokens = materialize(encoded(docs, path, end_id), "ids")
    counted = sorted(((r["n"], r["id"]) for r in id_counts(tokens).collect()), key=lambda r: (-r[0], r[1]))
    by_rank = np.array([i for _, i in counted], np.int64)
    rank_of = np.zeros(by_rank.max(initial=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    held = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rank, part = held.value, TaskContext.get().partitionId()
        for block, rows in enumerate(row_groups(batches, block_bytes, lambda r: len(r[2]) + 16)):
            doc_ids, lengths, _ = zip(*rows, strict=True)
            control, data = encode_block(rank[ids_of([r[1:] for r in rows])])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "control", "data"],
            )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(f"{out}/blocks")
    spark.createDataFrame([(i, int(d)) for i, d in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The documents of write_tokens: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ranks = spark.read.schema("rank long, id long").parquet(f"{out}/ranks").collect()
    ids = np.zeros(len(ranks), "<u4")
    for rank, i in ranks:
        ids[rank] = i
    held = spark.sparkContext.broadcast(ids)
    blocks = spark.read.schema(BLOCK).parquet(f"{out}/blocks")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Two small sums: over the blocks of each part and over the parts.
    sizes = blocks.select("part", "block", total.alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    starts = sizes.select("part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start")).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("first"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                n = np.array(row["lengths"], np.int64)
                tokens = held.value[decode_block(row["control"], row["data"], int(n.sum()))].tobytes()
                ends = np.cumsum(n)
                crc = [zlib.crc32(tokens[4 * s : 4 * e]) for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * k, pa.int64()), pa.array([row["block"]] * k, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "block", "in_block", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(run, "doc_id long, part long, block long, in_block long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write all rows of docs to files in the shared folder and return what is read back from them: doc_id, start, n_tokens, ids_crc32.

    Null texts have the end id alone; rows without doc_id come first; rows of one doc_id stand in either order and
    each has its own start; texts of any length are encoded whole, in memory in proportion to the longest; other columns are
    ignored; an empty table gives none.
    """
    out = f"{shared_dir(docs.sparkSession)}/trackframe/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, out)
    for_the_session(docs.sparkSession, out)
    return read_tokens(docs.sparkSession, out)
