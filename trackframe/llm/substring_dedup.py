"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

The reference is every block of documents, indexed by its windows of `window` words: the index is dealt out by
each window's anchor (the smallest hash of its 8-word runs), so that equal windows meet in one task
while neighbouring windows, which share an anchor, travel together. A lookup answers where a window
occurs first. A document is then parsed greedily from left to right: a factor starts at a word whose
window occurs earlier, runs on as long as the next window continues in the same source, and the next factor is
sought behind its end. Factors have `window` words or more and are duplicate spans; the windows
that cross a factor's end are checked by their own lookups, and add theirs. Windows that meet are told apart by 64 bits,
mixed from the hash of their anchor and 48 bits of their own.

An anchor that many windows share, such as a frequent phrase's, is hot: its windows are dealt out by
their own hashes, so that no task gets a frequent phrase whole. Which anchors are hot is found in a pass of its own, which
counts a share of all blocks' windows and sums the counts.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackframe.llm.common import distinct_words, free_name, quoted, row_groups

WINDOW, RUN = 20, 8
NULL_ID = np.iinfo(np.int64).min
#: Text bytes that a task hashes at once, and that a bucket of the index stands for.
BLOCK_BYTES, BUCKET_BYTES = 6_000_000, 8_000_000
#: Of how many windows a block counts one; windows of all blocks that make an anchor hot; anchors treated so at most (8 bytes each in
#: every task; which ones are chosen changes nothing but where windows meet); partitions at most, which then hold several buckets.
SHARE, HOT, MOST_HOT, MOST_PARTITIONS = 128, 3072, 1_000_000, 20_000
#: Odd multipliers for mixing.
MIX = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(20).integers(2**61, 2**63, 8)]
PARTS = {"doc_id": "<i8", "text_crc": "<u4", "per_doc": "<u4", "pos": "<u4", "length": "<u4", "anchor": "<u8", "low": "<u4", "high": "<u2", "src_id": "<i8", "src_pos": "<u4"}

FOUND = ("key_id", "text_crc", "pos", "length", "src_id", "src_pos")


def mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX[k]
    return x ^ (x >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray, shift: int, k: int) -> np.ndarray:
    """Hash of the run at i and the run at i + shift, for every i that has both."""
    n = max(0, min(len(a), len(b) - shift))
    return mix(a[:n] * MIX[k] + b[shift : shift + n], k)


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start: the anchor and the hash of the `window` words there, from the words' hashes."""
    by = {1: words}
    for k, size in enumerate((2, 4, 8, 16)):
        by[size] = joined(by[size // 2], by[size // 2], size // 2, k)
    size, whole, k = 16, by[16], 4
    if window < 16:
        size, whole = 8, by[8]
    while size < window:
        step = min(window - size, size)
        piece = max(s for s in by if s <= step)
        whole, size, k = joined(whole, by[piece], size, k), size + piece, min(k + 1, 7)
    low, size, n = by[RUN], 1, window - RUN + 1
    while size < n:
        step = min(size, n - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    return low[: len(whole)], whole


def runs(*breaks: np.ndarray) -> np.ndarray:
    """Starts of runs: row 0 and each row marked in one of `breaks` (marks stand for rows 1, 2, ...)."""
    mark = np.zeros(len(breaks[0]) + 1, bool)
    mark[0] = True
    for b in breaks:
        mark[1:] |= b
    return np.flatnonzero(mark)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every word, words of each text)."""
    from xxhash import xxh64_intdigest

    words, index, sizes = distinct_words(texts)
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))[index], sizes


def hot_anchors(docs: DataFrame, window: int, most: int = MOST_HOT) -> np.ndarray:
    """Sorted anchors that about HOT windows or more of all blocks have; of too many, those with most windows.

    A block counts one window in SHARE, chosen by the window's hash and the block's, so that what is frequent over all
    blocks shows in the sum however few of its windows each block has, and the sums are small.
    """

    def run(batches):
        import pyarrow as pa

        for rows in row_groups(batches, BLOCK_BYTES, lambda r: len(r[0])):
            hashed, sizes = hashed_words([t for (t,) in rows])
            if len(hashed) < window:
                continue
            anchor, whole = window_hashes(hashed, window)
            left = np.repeat(np.cumsum(sizes), sizes)[: len(whole)] - np.arange(len(whole))
            block = np.bitwise_xor.reduce(hashed[:: max(1, len(hashed) // 1000)])
            counted = (left >= window) & (mix(whole ^ block, 1) % np.uint64(SHARE) == 0)
            # Like the index, which sends a window once a block.
            _, first = np.unique(whole[counted], return_index=True)
            at, n = np.unique(anchor[counted][first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n)], ["anchor", "n"])

    found = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * SHARE >= HOT)
    got = found.orderBy(F.desc("n"), "anchor").limit(most).select("anchor").toArrow().column(0)
    return np.sort(got.to_numpy().astype(np.int64).view(np.uint64))


def index_block(rows: list, window: int, buckets: int, hot: np.ndarray):
    """Rows of the index from one block of documents: (bucket, {part: array}).

    Of a window found several times in the block only the first is sent; the others are known to be
    repeats, and travel as such (src_id, src_pos), in runs. So a passage in very many documents costs one row a block.
    """
    rows = sorted({(d, zlib.crc32(t)): t for d, t in rows}.items(), key=lambda r: r[0])
    hashed, sizes = hashed_words([t for _, t in rows])
    if len(hashed) < window:
        return
    doc = np.repeat(np.arange(len(rows)), sizes)
    pos = np.arange(len(hashed)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids, crcs = np.array([d for (d, _), _ in rows], np.int64), np.array([c for (_, c), _ in rows], np.uint32)
    anchor, whole = window_hashes(hashed, window)
    at = np.flatnonzero(pos[: len(whole)] + window <= sizes[doc[: len(whole)]])
    if not len(at):
        return
    anchor, whole = anchor[at], whole[at]
    key = mix(anchor ^ mix(whole, 6), 7)
    order = np.argsort(key)
    starts = runs(key[order][1:] != key[order][:-1])
    first = np.empty(len(at), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.r_[starts, len(at)]))
    d, p = doc[at], pos[at]
    again = (ids[d[first]] != ids[d]) | (p[first] != p)

    def send(own: np.ndarray, begin: np.ndarray, bucket: np.ndarray, more: dict):
        """own: windows in order; begin: where runs of them start; bucket: of each run."""
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = runs(bucket[by_bucket][1:] != bucket[by_bucket][:-1])
        length = np.diff(np.r_[begin, len(own)])
        for chosen in np.split(by_bucket, cuts[1:]):
            w = own[begin[chosen]]
            s = runs(d[w][1:] != d[w][:-1])
            inside = np.repeat(begin[chosen] - np.cumsum(length[chosen]) + length[chosen], length[chosen]) + np.arange(length[chosen].sum())
            yield int(bucket[chosen[0]]), {"doc_id": ids[d[w[s]]], "text_crc": crcs[d[w[s]]], "per_doc": np.diff(np.r_[s, len(w)]), "pos": p[w], "length": length[chosen]} | {k: f(w, own[inside]) for k, f in more.items()}

    if len(own := np.flatnonzero(~again)):
        a = anchor[own]
        where = mix(a, 5)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
            where = np.where(is_hot, key[own], where)
        where = (where % np.uint64(buckets)).astype(np.int64)
        begin = runs(np.diff(at[own]) != 1, d[own][1:] != d[own][:-1], a[1:] != a[:-1], where[1:] != where[:-1])
        yield from send(own, begin, where[begin], {"anchor": lambda w, i: anchor[w], "low": lambda w, i: whole[i].astype(np.uint32), "high": lambda w, i: (whole[i] >> np.uint64(32)).astype(np.uint16)})
    if len(own := np.flatnonzero(again)):
        src = first[own]
        begin = runs(np.diff(at[own]) != 1, d[own][1:] != d[own][:-1], np.diff(at[src]) != 1, d[src][1:] != d[src][:-1])
        of_doc = mix(ids.astype(np.uint64) ^ (crcs.astype(np.uint64) << np.uint64(32)), 2)
        yield from send(own, begin, (of_doc[d[own[begin]]] % np.uint64(buckets)).astype(np.int64), {"src_id": lambda w, i: ids[d[first[w]]], "src_pos": lambda w, i: p[first[w]]})


def look_up(parts: dict):
    """The repeats of one bucket, in runs: arrays of doc_id, text_crc, pos, length, src_id, src_pos.

    parts: lists of arrays as index_block made them.
    """
    found = []
    indexed = [k for k, a in enumerate(parts["anchor"]) if len(a)]
    cat = lambda name, of: np.concatenate([parts[name][k] for k in of]) if of else np.zeros(0, PARTS[name])
    if indexed:
        per, length = cat("per_doc", indexed).astype(np.int64), cat("length", indexed).astype(np.int64)
        n = length.sum()
        run = np.repeat(np.arange(len(length)), length)
        pos = cat("pos", indexed).astype(np.int64)[run] + np.arange(n) - np.repeat(np.cumsum(length) - length, length)
        doc_of = np.repeat(np.arange(len(per)), per)[run]
        ids, crcs = cat("doc_id", indexed), cat("text_crc", indexed)
        key = mix(cat("anchor", indexed)[run] ^ ((cat("low", indexed) | cat("high", indexed).astype(np.uint64) << np.uint64(32)) * MIX[3]), 4)
        order = np.argsort(key)
        same = np.zeros(n, bool)
        same[1:] = key[order][1:] == key[order][:-1]
        same[:-1] |= same[1:]
        order = order[same]  # windows that occur more than once
        if len(order):
            order = order[np.lexsort((pos[order], ids[doc_of[order]], key[order]))]
            starts = runs(key[order][1:] != key[order][:-1])
            head = np.repeat(order[starts], np.diff(np.r_[starts, len(order)]))
            again = (ids[doc_of[order]] != ids[doc_of[head]]) | (pos[order] != pos[head])
            own, src = order[again], head[again]
            by = np.argsort(own)
            own, src = own[by], src[by]
            if len(own):
                begin = runs(doc_of[own][1:] != doc_of[own][:-1], np.diff(pos[own]) != 1, doc_of[src][1:] != doc_of[src][:-1], np.diff(pos[src]) != 1)
                o, s = own[begin], src[begin]
                found.append((ids[doc_of[o]], crcs[doc_of[o]], pos[o], np.diff(np.r_[begin, len(own)]), ids[doc_of[s]], pos[s]))
    known = [k for k, a in enumerate(parts["src_id"]) if len(a)]
    if known:
        per = cat("per_doc", known)
        found.append((np.repeat(cat("doc_id", known), per), np.repeat(cat("text_crc", known), per), cat("pos", known), cat("length", known), cat("src_id", known), cat("src_pos", known)))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else None


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key_id, text_crc, found): per document, the runs of its windows that occur earlier.

    docs: key_id long (no null), text binary. found: arrays (pos, length, src_id, src_pos), in order of pos.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    hot = spark.sparkContext.broadcast(hot_anchors(docs, window))

    def run(batches):
        import pyarrow as pa

        for rows in row_groups(batches, BLOCK_BYTES, lambda r: len(r[1])):
            for bucket, parts in index_block(rows, window, buckets, hot.value):
                none = np.zeros(0, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *(pa.array([parts.get(k, none).astype(t).tobytes()], pa.binary()) for k, t in PARTS.items())], ["bucket", *PARTS])

    def by_key(batches, make):
        """make(rows of a key) for rows sorted by their first column."""
        held: list = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield from make(held)
                    held = []
                held.append(row)
        if held:
            yield from make(held)

    def search(held):
        import pyarrow as pa

        parts = {k: [np.frombuffer(r[i + 1], t) for r in held] for i, (k, t) in enumerate(PARTS.items())}
        if (found := look_up(parts)) is None:
            return
        # A row for each group of documents, not for each document: what comes back is a few large rows.
        group = (mix(found[0].astype(np.uint64) ^ (found[1].astype(np.uint64) << np.uint64(32)), 2) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.r_[runs(group[order][1:] != group[order][:-1]), len(order)]
        data = [[c[order][a:b].astype(np.int64).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for c in found]
        yield pa.RecordBatch.from_arrays([pa.array(group[order][cuts[:-1]]), *(pa.array(c, pa.binary()) for c in data)], ["doc_group", *FOUND])

    def gather(held):
        import pyarrow as pa

        ids, crcs, *rest = (np.concatenate([np.frombuffer(r[k + 1], np.int64) for r in held]) for k in range(len(FOUND)))
        order = np.lexsort((rest[0], crcs, ids))
        ids, crcs = ids[order], crcs[order]
        cuts = np.r_[runs(ids[1:] != ids[:-1], crcs[1:] != crcs[:-1]), len(ids)]
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(c[order])) for c in rest]
        yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), pa.array(crcs[cuts[:-1]]), *lists], list(FOUND))

    index = docs.select("key_id", "text").mapInArrow(run, "bucket long, " + ", ".join(f"{k} binary" for k in PARTS))
    n = max(min(buckets, MOST_PARTITIONS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits = index.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: by_key(b, search), "doc_group long, " + ", ".join(f"{k} binary" for k in FOUND))
    found = hits.repartition(n, "doc_group").sortWithinPartitions("doc_group").mapInArrow(lambda b: by_key(b, gather), "key_id long, text_crc long, " + ", ".join(f"{k} array<bigint>" for k in FOUND[2:]))
    return found.select("key_id", "text_crc", F.struct(*FOUND[2:]).alias("found"))


def parse(found: dict, window: int) -> tuple[list[tuple], list[tuple]]:
    """Greedy factors (start, words, src_id, src_start) of a document, and the spans (start, end) of its repeated words.

    found: the runs of windows that occur earlier, in order. A factor begins at the first such window behind the
    last factor, and goes on while the next window continues in the same source. Of the windows
    before a factor's end that do not lie inside it, those found are spans too.
    """
    factors, spans, end = [], [], 0
    whole: list = []
    for pos, n, src, start in zip(found["pos"], found["length"], found["src_id"], found["src_pos"], strict=True):
        if whole and whole[-1][2] == src and whole[-1][0] + whole[-1][1] == pos and whole[-1][3] + whole[-1][1] == start:
            whole[-1][1] += n
        else:
            whole.append([pos, n, src, start])
    for pos, n, src, start in whole:
        if pos < end:  # these windows cross the last factor's end
            spans.append((pos, min(pos + n, end) + window - 1))
        first = max(pos, end)
        if first < pos + n:
            end = pos + n + window - 1
            factors.append((first, end - first, src, start + first - pos))
            spans.append((first, end))
    return factors, spans


def kept_words(words: list, spans: list[tuple]) -> list:
    """The words outside the spans, which are in order of their starts."""
    out, at = [], 0
    for start, end in spans:
        if start > at:
            out += words[at:start]
        at = max(at, end)
    return out + words[at:]


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False, report: bool = True) -> DataFrame:
    """Remove words covered by a window of `window` words that starts earlier (smaller doc_id, or same document before).

    Every row of docs gives one row: its columns with `text` as the kept words joined by one space (the
    text as it was where nothing goes), and with `report` n_words, n_removed, factors (start, words, src_id,
    src_start), which take the place of columns of these names.
    With `digest` only doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space).
    Windows are judged on the input. Null texts have no words; a null doc_id sorts before all and shows as
    the least long in factors; rows of one doc_id are one document, compared by their starts only, so that
    repeated rows get the same result. Texts of any length are indexed whole. An empty table gives none.
    """
    own = [c for c in docs.columns if c.lower() not in ("text", "doc_id")]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("key_id"), text.alias("text"), F.struct(F.col("doc_id"), F.col("text").isNull().alias(free_name("no_text_", docs)), *([] if digest else [F.col(quoted(c)) for c in own])).alias("rest"))
    found = repeated_windows(keyed, window)
    both = keyed.withColumn("text_crc", F.crc32("text")).join(found.hint("shuffle_hash"), ["key_id", "text_crc"], "left").select("text", "found", "rest")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out, texts = [], []
            for text, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split()
                factors, spans = parse(hits, window) if hits else ([], [])
                kept = kept_words(words, spans)
                if digest:
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                else:
                    out.append((len(words), len(words) - len(kept), [dict(zip(("start", "words", "src_id", "src_start"), f, strict=True)) for f in factors]))
                    texts.append((b" ".join(kept) if spans else text).decode())
            rest = b.column(2)
            cols = list(zip(*out, strict=True)) or [[], [], []]
            if digest:
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
                yield pa.RecordBatch.from_arrays([rest.field(0).cast(pa.int64()), *arrays], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                no_text = rest.field(1).to_pylist()
                kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "words", "src_id", "src_start")]))
                new = pa.array([None if n else t for n, t in zip(no_text, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([rest, new, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["rest", "new_text", "n_words_", "n_removed_", "factors_"])

    if digest:
        return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    factor = "array<struct<start:bigint,words:bigint,src_id:bigint,src_start:bigint>>"
    kind = StructType([both.schema["rest"], *StructType.fromDDL(f"new_text string, n_words_ long, n_removed_ long, factors_ {factor}")])
    made = both.mapInArrow(run, kind)
    new = {"n_words": "n_words_", "n_removed": "n_removed_", "factors": "factors_"} if report else {}
    kept = [F.col("new_text").alias(c) if c.lower() == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns if c.lower() not in new]
    return made.select(*kept, *(F.col(c).alias(k) for k, c in new.items()))
