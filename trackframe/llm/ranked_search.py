"""Ranked lexical search through bit-sliced Bloom signatures.

Every document has a Bloom signature of its terms. Documents of alike size stand together in blocks, whose signatures
lie bit-sliced: one bitmap over the block's documents for each bit of the signature. The bits of a term, their bitmaps
intersected, give the documents that may hold it: all that do, and a few more. A signature also holds, for
LEVELS of repetition, that a term occurs so often, which bounds its occurrences from above.

A search takes, for each query, the sum of its terms' bitmaps weighted by what a term can add at most: an upper bound of
every document's score. The `most` documents with the greatest bounds are scored exactly from their
texts; their least score is a floor that no result lies below. Every document whose bound reaches the floor is then
scored exactly, so false members of a bitmap cost work, never a result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import distinct_words, materialize, row_groups, sums_of, take_runs

#: Byte table: what separates terms as a space, A-Z in lower case; bytes of other letters stay.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Occurrences that have bits of their own, and what bounds the occurrences of a term that stays below the next.
LEVELS = np.array([1, 2, 3, 4, 6, 9, 13, 20])
AT_MOST = [1, 2, 3, 5, 8, 12, 19, None]
#: Bits set for a key (a term and a level); signature bits for a key at least; bits of a block.
HASHES, BITS, AREA = 6, 16, 1 << 23
#: Queries answered together; candidate documents that are sent to the tasks at most (beyond, they are joined).
QUERIES, SENT = 1024, 200_000
INDEX = "ids array<bigint>, no_id array<boolean>, sizes array<bigint>, width long, slices binary, at array<int>, df array<bigint>"


def hash_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def keys_of(hashes: np.ndarray, level: int) -> np.ndarray:
    """64-bit keys of terms at a level."""
    x = (hashes + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def places(keys: np.ndarray, width: int) -> np.ndarray:
    """The HASHES slices of each key in a signature of `width` bits, a power of two."""
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(width - 1) for i in range(HASHES)]).astype(np.int64)


def term_rows(texts: list[bytes]):
    """(distinct terms, and of every pair of text and term: text, term, occurrences; terms of each text with repeats)."""
    terms, index, counts = distinct_words(texts, table=TERM_BYTES)
    pair, times = np.unique(np.repeat(np.arange(len(texts)), counts) * max(len(terms), 1) + index, return_counts=True)
    return terms, *np.divmod(pair, max(len(terms), 1)), times, counts


def with_key(docs: DataFrame) -> DataFrame:
    """id, no_id (the row has none), text in bytes."""
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, F.lit(0)).alias("id"), doc.isNull().alias("no_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


class Block:
    """Documents of one signature width that wait for their bitmaps."""

    def __init__(self, width: int):
        self.width, self.room = width, max(8, AREA // width)
        self.held: list[tuple] = []  # (ids, no_id, sizes, keys of each, all keys)

    def add(self, *rows):
        self.held.append(rows)
        while sum(len(h[0]) for h in self.held) >= self.room:
            yield self.take(self.room)

    def take(self, n: int) -> tuple:
        """The first n documents as a row of the index."""
        ids, none, sizes, counts, keys = (np.concatenate(c) for c in zip(*self.held, strict=True))
        cut = int(counts[:n].sum())
        self.held = [(ids[n:], none[n:], sizes[n:], counts[n:], keys[cut:])] if len(ids) > n else []
        n = min(n, len(ids))
        slices = np.zeros((self.width, -(-n // 8) * 8), bool)
        row = np.repeat(np.arange(n), counts[:n])
        for at in places(keys[:cut], self.width):
            slices[at, row] = True
        return ids[:n].tolist(), none[:n].tolist(), sizes[:n].tolist(), self.width, np.packbits(slices, axis=1).tobytes(), None, None


def index(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Blocks of all documents with a term (ids, no_id, sizes: their terms with repeats, width, slices), and for each task a row with
    the number of its documents that hold the terms asked about (at, df)."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import pyarrow as pa

        known, blocks = held.value, {}
        df = np.zeros(len(known), np.int64)
        put = lambda r: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(r, schema, strict=True)], schema=schema)
        longs = pa.list_(pa.int64())
        schema = pa.schema(zip(["ids", "no_id", "sizes", "width", "slices", "at", "df"], [longs, pa.list_(pa.bool_()), longs, pa.int64(), pa.binary(), pa.list_(pa.int32()), longs], strict=True))
        for rows in row_groups(batches, 8_000_000, lambda r: len(r[2])):
            ids, none, texts = zip(*rows, strict=True)
            ids, none = np.array(ids, np.int64), np.array(none, bool)
            own, doc, term, times, sizes = term_rows(texts)
            asked = np.fromiter((known.get(t, -1) for t in own), np.int64, len(own))[term]
            df += np.bincount(asked[asked >= 0], minlength=len(df))
            hashes = hash_of(own)
            levels = [times >= n for n in LEVELS]
            key = np.concatenate([keys_of(hashes, k)[term[has]] for k, has in enumerate(levels)])
            of = np.concatenate([doc[has] for has in levels])
            key = key[np.argsort(of, kind="stable")]
            n_keys = np.bincount(of, minlength=len(ids))
            width = 1 << np.ceil(np.log2(np.maximum(BITS * n_keys, 256))).astype(np.int64)
            width[n_keys == 0] = 0
            for w in np.unique(width[width > 0]).tolist():
                at = np.flatnonzero(width == w)
                block = blocks.setdefault(w, Block(w))
                yield from map(put, block.add(ids[at], none[at], sizes[at], n_keys[at], take_runs(key, n_keys, at)))
        for block in blocks.values():
            if block.held:
                yield put(block.take(block.room))
        if len(at := np.flatnonzero(df)):
            yield put((None, None, None, None, None, at.tolist(), df[at].tolist()))

    return with_key(docs).mapInArrow(run, INDEX)


class Queries:
    """Queries as term numbers, repeats and weights, for the tasks."""

    def __init__(self, texts: list[str]):
        counted = [Counter(w for w in t.encode().translate(TERM_BYTES).split(b" ") if w) for t in texts]
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*counted)))} if counted else {}
        self.sizes = np.array([len(c) for c in counted], np.int64)
        self.at = np.array([self.terms[t] for c in counted for t in c], np.int64)
        self.times = np.array([n for c in counted for n in c.values()], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.keys = [keys_of(hash_of(list(self.terms)), k) for k in range(len(LEVELS))]

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))], np.int64)
        self.adds = self.times * self.weight[self.at]

    def damp(self, sizes: np.ndarray) -> np.ndarray:
        """What a document's length puts against its terms."""
        return 100 - 25 + 25 * sizes * self.n_docs // self.n_terms

    def bounds(self, width: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the scores of a block: queries x documents."""
        bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
        damp, out, below = self.damp(sizes), np.zeros((len(self.sizes), len(sizes)), np.int64), 0
        may, alive = None, np.arange(len(self.terms))
        for level, most in enumerate(AT_MOST):
            first, *more = places(self.keys[level][alive], width)
            own = bits[first] if may is None else bits[first] & may
            for at in more:
                own &= bits[at]
            stay = own.any(1)
            may, alive = own[stay], alive[stay]
            if not len(alive):
                break
            row = np.full(len(self.terms), -1)
            row[alive] = np.arange(len(alive))
            adds = np.full(len(sizes), 1_000_000) if most is None else 1_000_000_000 * most // (1000 * most + 12 * damp)
            here = np.unpackbits(may, axis=1, count=len(sizes))
            for q, end in enumerate(self.ends.tolist()):
                at = row[self.at[end - self.sizes[q] : end]]
                has = at >= 0
                if has.any():
                    weighted = self.adds[end - self.sizes[q] : end][has].astype(np.float64) @ here[at[has]]  # exact: far below 2**53
                    out[q] += weighted.astype(np.int64) * (adds - below)
            below = adds
        return out

    def scores(self, doc: np.ndarray, query: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Exact scores of (doc, query); `pairs`: sorted doc * terms + term, which occurs `times`."""
        n = self.sizes[query]
        runs = np.repeat(np.arange(len(doc)), n)
        want = doc[runs] * len(self.terms) + take_runs(self.at, self.sizes, query)
        at = np.minimum(np.searchsorted(pairs, want), max(len(pairs) - 1, 0))
        tf = np.where(pairs[at] == want, times[at], 0) if len(pairs) else np.zeros(len(want), np.int64)
        return sums_of(take_runs(self.adds, self.sizes, query) * (1_000_000_000 * tf // (1000 * tf + 12 * self.damp(sizes)[doc][runs])), n)


def best(rows: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
    """Of each query the `most` rows of the highest score; equal scores by id, rows without one last."""
    order = np.lexsort((rows["id"], rows["no_id"], -rows["score"], rows["query"]))
    query = rows["query"][order]
    first = np.searchsorted(query, query)
    return {k: v[order[np.arange(len(order)) - first < most]] for k, v in rows.items()}


EMPTY = {"query": np.zeros(0, np.int32), "id": np.zeros(0, np.int64), "no_id": np.zeros(0, bool), "score": np.zeros(0, np.int64)}
SCORED = "query int, id long, no_id boolean, score long"


def _batch(rows: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], list(rows))


def _joined(a: dict, b: dict) -> dict:
    return {k: np.concatenate([a[k], b[k]]) for k in EMPTY}


def top(rows: DataFrame, most: int) -> DataFrame:
    """SCORED rows with their rank, up to `most` a query; in two steps, so that a query's rows are no single task's."""
    order = [F.col("score").desc(), "no_id", "id"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = rows.withColumn("share", F.pmod(F.xxhash64("id", "no_id"), F.lit(64))).withColumn("rank", rank("query", "share")).where(F.col("rank") <= most)
    return some.drop("share").withColumn("rank", rank("query")).where(F.col("rank") <= most)


def rescored(docs: DataFrame, candidates: DataFrame, held, most: int) -> DataFrame:
    """The `most` best scores above 0 of each query and task, exact, of candidates(id, no_id, query)."""
    own = candidates.groupBy("id", "no_id").agg(F.collect_set("query").alias("queries"))
    own = materialize(own, "candidates")
    n, pairs = own.agg(F.count("*"), F.coalesce(F.sum(F.size("queries")), F.lit(0))).first()
    met = with_key(docs).join(F.broadcast(own) if n <= SENT and pairs <= 10 * SENT else own, ["id", "no_id"])

    def run(batches):
        queries, kept = held.value, EMPTY
        for rows in row_groups(batches, 4_000_000, lambda r: len(r[2]) + 400 * len(r[3])):
            ids, none, texts, wanted = zip(*rows, strict=True)
            terms, doc, term, times, sizes = term_rows(texts)
            asked = np.fromiter((queries.terms.get(t, -1) for t in terms), np.int64, len(terms))[term]
            pair = doc[asked >= 0] * len(queries.terms) + asked[asked >= 0]
            order = np.argsort(pair)
            of, query = np.repeat(np.arange(len(ids)), [len(w) for w in wanted]), np.concatenate([np.array(w, np.int32) for w in wanted])
            ids, none = np.array(ids, np.int64), np.array(none, bool)
            for at in range(0, len(of), 20_000):
                d, q = of[at : at + 20_000], query[at : at + 20_000]
                score = queries.scores(d, q, sizes, pair[order], times[asked >= 0][order])
                has = score > 0
                kept = best(_joined(kept, {"query": q[has], "id": ids[d[has]], "no_id": none[d[has]], "score": score[has]}), most)
        yield _batch(kept)

    return met.select("id", "no_id", "text", "queries").mapInArrow(run, SCORED)


def _answer(docs: DataFrame, texts: list[str], most: int) -> DataFrame | None:
    """SCORED rows with rank for the queries of these texts, numbered in their order."""
    spark, queries = docs.sparkSession, Queries(texts)
    if not queries.terms:
        return None
    blocks = materialize(index(docs, queries.terms), "signatures")
    rows = blocks.where("width is not null").select("ids", "no_id", "sizes", "width", "slices")
    n_docs, n_terms = rows.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    df = blocks.where("at is not null").select(F.explode(F.arrays_zip("at", "df")).alias("e")).groupBy("e.at").agg(F.sum("e.df")).collect()
    if not df:
        return None
    queries.weigh(n_docs, n_terms, dict(df))
    held = spark.sparkContext.broadcast(queries)

    def each_block(batches):
        for b in batches:
            for ids, none, sizes, width, slices in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield np.array(ids, np.int64), np.array(none, bool), held.value.bounds(width, np.array(sizes, np.int64), slices)

    def greatest(batches):
        kept = EMPTY
        for ids, none, bound in each_block(batches):
            k = min(most, len(ids))
            doc = np.argpartition(-bound, k - 1, axis=1)[:, :k].reshape(-1)
            query = np.repeat(np.arange(len(bound), dtype=np.int32), k)
            score = bound[query, doc]
            has = score > 0
            kept = best(_joined(kept, {"query": query[has], "id": ids[doc[has]], "no_id": none[doc[has]], "score": score[has]}), most)
        yield _batch(kept)

    seeds = top(rows.mapInArrow(greatest, SCORED), most).select("id", "no_id", "query")
    found = top(rescored(docs, seeds, held, most), most)
    floor = np.ones(len(texts), np.int64)
    for q, score in found.where(F.col("rank") == most).select("query", "score").collect():
        floor[q] = score
    sent = spark.sparkContext.broadcast(floor)

    def reaching(batches):
        for ids, none, bound in each_block(batches):
            query, doc = np.nonzero(bound >= sent.value[:, None])
            yield _batch({"id": ids[doc], "no_id": none[doc], "query": query.astype(np.int32)})

    return top(rescored(docs, rows.mapInArrow(reaching, "id long, no_id boolean, query int"), held, most), most)


def search(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of items(item_id, text) its `most` highest-scoring documents of
    docs(doc_id, text) with a score above 0, equal scores by doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, in whole texts, A-Z in lower case; a null text has
    none. Documents without a term do not count. Rows of one doc_id are documents of their own, those without doc_id rank behind
    others of their score. Rows of one item_id are answered each; an item without a term, or whose terms no document holds,
    has no row. An empty table gives none; other columns are ignored. Items are answered in blocks of about QUERIES distinct
    texts, each in passes over all documents.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id"), F.col("text").cast("string").alias("query_text")).where("query_text is not null")
    texts = asked.select("query_text").distinct()
    n = max(1, -(-texts.count() // QUERIES))
    out = spark.createDataFrame([], asked.select("item_id").schema).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    for block in range(n):
        own = sorted(r[0] for r in texts.where(F.pmod(F.xxhash64("query_text"), F.lit(n)) == block).collect())
        if (found := _answer(docs, own, most)) is not None:
            numbered = spark.createDataFrame(list(enumerate(own)), "query int, query_text string")
            doc = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
            out = out.union(found.join(numbered, "query").join(asked, "query_text").select("item_id", "rank", doc, "score"))
    return out


#: DuckDB SQL for search() over documents and benchmark.
_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE = f"""
WITH held AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS t FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS own FROM held GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(own)::BIGINT AS terms FROM sizes),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY t), total),
asked AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, {_TERMS} AS t FROM benchmark) GROUP BY ALL),
damped AS (SELECT doc_id, 100 - 25 + (25 * own * docs) // terms AS m FROM sizes, total),
scored AS (SELECT item_id, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN held USING (t) JOIN weights USING (t) JOIN damped USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20
"""
