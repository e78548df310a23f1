"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Candidates meet by agreeing on three of five bit blocks (two differing bits touch at most two blocks).
Inside a bucket the fingerprints stand as vertical bit planes, 64 rows a word: one query's distances to
64 rows are counted at once by carry-save bitwise counters, and a word is abandoned as soon as all its rows are
beyond the radius.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import connected_components, free_name, last_stays, materialize, min_labels, row_groups, stream_groups, text_bytes, tiles

RADIUS, BLOCKS = 2, 5
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Odd multipliers for mixing.
MIX = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(3).integers(2**61, 2**63, 16)]
LANE = (np.arange(8) * 256)[None, :]
#: Of similar_groups: words of a fingerprint; keys of a text, and least hashes a key tells; forests of links verified.
WORDS, BANDS, ROWS, FORESTS = 8, 10, 4, 2
#: Of missing_pairs: bits of a set's parities; a shingle that more rows hold than CROWDED brings its rows' parities along.
PARITIES, CROWDED = 1024, 4
SEEDS = np.random.default_rng(4).integers(0, 2**63, BANDS * ROWS).astype(np.uint64)


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the blocks that two fingerprints within the radius must agree on, for every choice of blocks."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    own = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(own, blocks - radius)]


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `shingle` words, repeats included; of the whole sequence if it has fewer.

    A-Z is lower-cased; words are runs of bytes other than space and 0x09-0x0D.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words] if words else []
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits set in over half the hashes, as one unsigned word; zero for none."""
    ones = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + LANE).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return np.packbits(2 * ones.ravel() > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, unsigned: bit set if set in over half the shingles' hashes; 0 for no word."""
    return int(majority(shingle_hashes(text, shingle, seed))[0])


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """Further fingerprints of distinct shingle hashes, each from its own mixing of them, one behind the other."""
    out = []
    for k in range(words):
        x = (hashes ^ MIX[k % len(MIX)]) * (MIX[(k + 1) % len(MIX)] + np.uint64(2 * k))
        out.append(majority((x ^ (x >> np.uint64(31))) * MIX[0]))
    return np.concatenate(out).tobytes()


def meeting_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set; each tells ROWS of its least hashes under as many mixings. Two sets agree on a key
    with the ROWS-th power of their similarity, whatever the size of the table."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        x = (hashes[None, at : at + 4096] ^ SEEDS[:, None]) * MIX[1]
        np.minimum(low, ((x ^ (x >> np.uint64(29))) * MIX[2]).min(1), out=low)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * MIX[3]
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (signed long with the fingerprint's bits) of every row of docs."""

    def run(batches):
        import pyarrow as pa

        for rows in row_groups(batches, 4_000_000, lambda r: len(r[1])):
            fp = np.array([fingerprint(r[1], shingle) for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def links_of(fp: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i < j) of the same group whose fingerprints differ in at most `radius` bits.

    fp: 64-bit words, (rows,) or (rows, words). starts: where each group begins, with the end appended.
    """
    n, none = len(fp), np.zeros(0, np.int64)
    if n < 2:
        return none, none
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    width = bits.shape[1]
    padded = np.zeros((width, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    row, end = np.arange(n), np.repeat(starts[1:], np.diff(starts))
    first, last = (row + 1) // 64, (end - 1) // 64
    count = np.where(row + 1 < end, last - first + 1, 0)
    query = np.repeat(row, count)
    word = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    # Rows of the word that come after the query and inside its group.
    full = ~np.uint64(0)
    low = np.clip(query + 1 - 64 * word, 0, 63).astype(np.uint64)
    high = np.clip(64 * (word + 1) - end[query], 0, 63).astype(np.uint64)
    alive = (full << low) & (full >> high)
    out_a, out_b = [], []
    for at in range(0, len(query), 1 << 16):
        q, w, ok = query[at : at + (1 << 16)], word[at : at + (1 << 16)], alive[at : at + (1 << 16)]
        levels = (radius + 1).bit_length()
        base = (1 << levels) - 1 - radius  # counters start so high that radius + 1 differences overflow
        counters = [np.full(len(q), full if base >> k & 1 else np.uint64(0)) for k in range(levels)]
        for p in range(width):
            carry = planes[p][w] ^ (np.uint64(0) - bits[q, p].astype(np.uint64))
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            ok = ok & ~carry
            if p % 8 == 7:
                stay = ok != 0
                if not stay.any():
                    q = q[:0]
                    break
                q, w, ok, counters = q[stay], w[stay], ok[stay], [c[stay] for c in counters]
        if len(q):
            hit, bit = np.nonzero(np.unpackbits(ok.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            out_a.append(q[hit])
            out_b.append(64 * w[hit] + bit)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = 1024) -> DataFrame:
    """Links (a, b: rep) that join the rows of distinct(rep long, fp long) within the radius; a star a group, not all pairs."""
    keyed = distinct.withColumn("mask", F.explode(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in block_masks(radius, radius + 3))))).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))

    def run(batches):
        import pyarrow as pa

        for t, starts in stream_groups(batches, ["mask", "key", "tile_a", "tile_b"], 100_000):
            rep = t.column("rep").to_numpy()
            order = np.lexsort((rep, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            rep, fp = rep[order], t.column("fp").to_numpy()[order].view(np.uint64)
            a, b = links_of(fp, starts, radius)
            label = min_labels(len(rep), a, b)
            to = np.flatnonzero(label != np.arange(len(rep)))
            if len(to):
                yield pa.RecordBatch.from_arrays([pa.array(rep[to]), pa.array(rep[label[to]])], ["a", "b"])

    return tiles(keyed, ["mask", "key"], "rep", tile).select("mask", "key", "tile_a", "tile_b", "rep", "fp").mapInArrow(run, "a long, b long").distinct()


def differing_share(similarity: float) -> float:
    """The share of fingerprint bits in which two shingle sets of that Jaccard similarity differ on average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def forest(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of links that join what all links a-b of n nodes join, the nearest first (Boruvka's minimum spanning forest)."""
    order = np.argsort(distance, kind="stable")
    label, chosen = np.arange(n), np.zeros(0, np.int64)
    while len(order := order[label[a[order]] != label[b[order]]]):
        own = np.r_[label[a[order]], label[b[order]]]
        # The first of each label's links, in order of (distance, place).
        by = np.argsort(np.r_[np.arange(len(order)), np.arange(len(order))], kind="stable")
        _, first = np.unique(own[by], return_index=True)
        chosen = np.union1d(chosen, order[by[first] % len(order)])
        label = min_labels(n, a[chosen], b[chosen])
    return chosen


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp (fingerprint of WORDS words), keys (BANDS, none of a text without words) and grams (its distinct
    shingles' hashes, 32 bits each, ascending) of every row of docs."""

    def run(batches):
        import pyarrow as pa

        for rows in row_groups(batches, 4_000_000, lambda r: len(r[1])):
            out = []
            for doc, text in rows:
                h = np.unique(shingle_hashes(text, shingle))
                out.append((doc, wide_fingerprint(h, WORDS), meeting_keys(h).tolist() if len(h) else [], np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "fp", "keys", "grams"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, fp binary, keys array<bigint>, grams binary")


def verified(links: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose shingle sets are `similarity` alike or more."""

    def run(batches):
        import pyarrow as pa

        for t in batches:
            a, b, x, y = (c.to_pylist() for c in t.columns)
            keep = []
            for i, (g, h) in enumerate(zip(x, y, strict=True)):
                both = np.frombuffer(g, "<u4"), np.frombuffer(h, "<u4")
                shared = len(np.intersect1d(*both, assume_unique=True))
                if shared >= similarity * (len(both[0]) + len(both[1]) - shared) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (a, b)], ["a", "b"])

    ids = materialize(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "linked")
    # Only the sets of linked texts are dealt.
    sets = sketched.where("doc_id is not null").join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "doc_id", "left_semi")
    x = links.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a")
    return x.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def frequent_shingles(sketched: DataFrame) -> np.ndarray:
    """Shingles that many texts hold, the most frequent last: at most 2 ** 18 of those that 3 of a 16th of the documents hold.

    They only settle the order of `rare_shingles`, which any order serves.
    """

    def run(batches):
        import pyarrow as pa

        for rows in row_groups(batches, 4_000_000, lambda r: len(r[0])):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(r[0] for r in rows), "<i4"))], ["h"])

    counts = sketched.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).select("grams").mapInArrow(run, "h int").groupBy("h").count().where("count >= 3")
    return counts.orderBy(F.desc("count"), "h").limit(1 << 18).toArrow().column("h").to_numpy()[::-1].view(np.uint32)


def must_share(size: np.ndarray, similarity: float) -> np.ndarray:
    """Of how many of its first shingles, in an order common to all sets, a set of that size shares at least one with any set of that similarity."""
    return size - np.maximum(1, np.ceil(similarity * size - 1e-9).astype(np.int64)) + 1


def must_overlap(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles two sets of sizes x and y share at least, if they are so similar."""
    return np.ceil(similarity / (1 + similarity) * (x + y) - 1e-6).astype(np.int64)


def parities(h: np.ndarray) -> bytes:
    """PARITIES bits: whether an odd number of the 32-bit hashes falls to each. Two sets differ in at least as many shingles as their bits."""
    return np.packbits(np.bincount(h % PARITIES, minlength=PARITIES) & 1).tobytes()


def least_shared(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """How many of their first `must_share` shingles two sets of sizes x and y share at least, if they are so similar.

    Of the set whose first shingles end earlier in the common order, all but what the other set lacks are among the other's first.
    """
    return np.maximum(1, np.minimum(must_share(x, similarity) - x, must_share(y, similarity) - y) + must_overlap(x, y, similarity))


def rare_shingles(sketched: DataFrame, similarity: float, frequent: np.ndarray) -> DataFrame:
    """doc_id, size (shingles), first (the `must_share` first of them, those of `frequent` last, else by hash) and bits (see `parities`) of every text with a word."""
    place = np.argsort(frequent)

    def run(batches):
        import pyarrow as pa

        known = frequent[place]
        for rows in row_groups(batches, 4_000_000, lambda r: len(r[1])):
            out = []
            for doc, grams in rows:
                h = np.frombuffer(grams, "<u4")
                at = np.searchsorted(known, h)
                often = known[np.minimum(at, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                order = np.r_[h[~often], frequent[np.sort(place[at[often]])]]
                out.append((doc, len(h), order[: must_share(np.array(len(h)), similarity)].view(np.int32), parities(h)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "size", "first", "bits"])

    return sketched.where("doc_id is not null and length(grams) > 0").select("doc_id", "grams").mapInArrow(run, "doc_id long, size int, first array<int>, bits binary")


def pairs_that_meet(rep: np.ndarray, component: np.ndarray, size: np.ndarray, chunk: np.ndarray, one: np.ndarray, starts: np.ndarray, similarity: float, most: int = 250_000, bits=None):
    """(a, b, times they meet, least_shared) of rows of the same group, other components and sizes that may be so similar, in parts of about `most` pairs.

    Where the group is a tile of two chunks (`one` is false), rows of one chunk do not meet there. With `bits` (the rows' `parities`, or None)
    those are left out whose bits alone differ more than so similar sets do. Rows of one component are not paired at all.
    """
    names, code = np.unique(rep, return_inverse=True)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((component, group))
    component, size, chunk, one, code = (x[order] for x in (component, size, chunk, one, code))
    # Where the rows of the row's component end in its group; its partners stand from there to the group's end.
    change = np.flatnonzero(np.r_[True, (component[1:] != component[:-1]) | (group[1:] != group[:-1])])
    after = np.repeat(np.r_[change[1:], len(rep)], np.diff(np.r_[change, len(rep)]))
    count = np.repeat(starts[1:], np.diff(starts)) - after
    known = np.zeros(len(rep), bool) if bits is None else np.array([bits[k] is not None for k in order], bool)
    if known.any():
        none = bytes(PARITIES // 8)
        words = np.frombuffer(b"".join(bits[k] or none for k in order), "<u8").reshape(len(rep), -1).T.copy()
    ends = np.cumsum(count)
    at = 0
    while at < len(rep):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = count[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) + np.repeat(after[at:to] - np.cumsum(n) + n, n)
        ok = one[i] | (chunk[i] != chunk[j])
        ok &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[ok], j[ok]
        if known[at:to].any() and len(i):
            differ = np.zeros(len(i), np.int64)
            for w in words:
                differ += np.bitwise_count(w[i] ^ w[j])
            ok = ~(known[i] & known[j]) | (differ <= size[i] + size[j] - 2 * must_overlap(size[i], size[j], similarity))
            i, j = i[ok], j[ok]
        if len(i):
            pair = np.minimum(code[i], code[j]) * len(names) + np.maximum(code[i], code[j])
            order = np.argsort(pair, kind="stable")
            met, first, times = np.unique(pair[order], return_index=True, return_counts=True)
            # The least of all: an id may have rows of several sizes.
            yield names[met // len(names)], names[met % len(names)], times, np.minimum.reduceat(least_shared(size[i], size[j], similarity)[order], first)
        at = to


def missing_pairs(sketched: DataFrame, groups: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Pairs (a, b) of groups(rep, component_id) in different components, among them all that are `similarity` alike or more.

    They meet by the shingles that must be shared (see `rare_shingles`), of which only those matter that two components hold, and stay if they
    meet as often as `least_shared` tells; crowded shingles are dealt out in tiles. Meeting by 32-bit hashes brings a few pairs too many, none too few.
    Where more than CROWDED rows meet, pairs that differ too much in their `parities` are never made; an id whose rows of one size differ brings none.
    """
    first = rare_shingles(sketched, similarity, frequent_shingles(sketched)).withColumnRenamed("doc_id", "rep")
    # Rows of one doc_id are one document, whatever their texts; so each of its rows counts.
    first = materialize(first.join(groups, "rep"), "first")
    dealt = first.select("rep", "component_id", "size", F.explode("first").alias("key"))
    live = dealt.groupBy("key").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), (F.count("*") > CROWDED).alias("crowded")).where("low <> high").select("key", "crowded")
    shared = materialize(dealt.join(live, "key").distinct(), "shared")
    bits = first.groupBy("rep", "size").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).select("rep", "size", F.expr("if(low = high, low, null)").alias("bits"))
    shared = shared.where("crowded").join(bits, ["rep", "size"], "left").unionByName(shared.where("not crowded").withColumn("bits", F.lit(None).cast("binary")))

    def compare(batches):
        import pyarrow as pa

        for t, starts in stream_groups(batches, ["key", "tile_a", "tile_b"], 20_000):
            rep, component, size, chunk, tile_a, tile_b = (t.column(c).to_numpy() for c in ("rep", "component_id", "size", "chunk", "tile_a", "tile_b"))
            for found in pairs_that_meet(rep, component, size.astype(np.int64), chunk, tile_a == tile_b, starts, similarity, bits=t.column("bits").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b", "met", "least"])

    met = tiles(shared, ["key"], "rep", tile).select("key", "tile_a", "tile_b", "chunk", "rep", "component_id", "size", "bits").mapInArrow(compare, "a long, b long, met long, least long")
    return met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("least").alias("least")).where("met >= least").select("a", "b")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tile: int = 1024) -> DataFrame:
    """(doc_id, component_id) of every row of docs: groups of texts whose shingle sets are `similarity` alike or more.

    Texts that share a key meet, in numbers that do not grow with the table, and are compared bit-sliced by
    SimHash fingerprints of 512 bits, with a radius 2.5 standard errors beyond the similarity's; of what lies within,
    the nearest links that join the same texts, twice over, are checked by the shingles themselves. These groups are right but may
    lack a link; so all pairs of different groups that can be alike (see `missing_pairs`) are checked too. Texts of the same shingles are one node.
    """
    bits, share = 64 * WORDS, differing_share(similarity)
    radius = int(bits * share + 2.5 * np.sqrt(bits * share * (1 - share)))

    def compare(batches):
        import pyarrow as pa

        for t, starts in stream_groups(batches, ["key", "tile_a", "tile_b"], 20_000):
            rep = t.column("rep").to_numpy()
            order = np.lexsort((rep, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            rep = rep[order]
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(len(rep), -1)[order]
            a, b = links_of(fp, starts, radius)
            for _ in range(FORESTS):
                distance = np.concatenate([np.bitwise_count(fp[a[i : i + 100_000]] ^ fp[b[i : i + 100_000]]).sum(1) for i in range(0, len(a), 100_000)] or [np.zeros(0)])
                chosen = forest(len(rep), a, b, distance)
                if not len(chosen):
                    break
                yield pa.RecordBatch.from_arrays([pa.array(rep[a[chosen]]), pa.array(rep[b[chosen]])], ["a", "b"])
                rest = np.setdiff1d(np.arange(len(a)), chosen, assume_unique=True)
                a, b = a[rest], b[rest]

    sketched = materialize(sketches(docs, shingle).withColumn("own", F.xxhash64("grams")), "sketches")
    distinct = sketched.groupBy("fp", "own").agg(F.min(F.struct("doc_id", "keys")).alias("m"), F.min("doc_id").alias("rep"))
    # A null id sorts first in the structs' minimum: the keys are those of a text of the same shingles all the same.
    distinct = materialize(distinct.select("fp", "own", "rep", F.col("m.keys").alias("keys")), "distinct")
    dealt = distinct.where("rep is not null").select("rep", "fp", F.explode("keys").alias("key"))
    found = tiles(dealt, ["key"], "rep", tile).select("key", "tile_a", "tile_b", "rep", "fp").mapInArrow(compare, "a long, b long").distinct()
    links = materialize(verified(materialize(found, "near"), sketched, similarity), "similar")
    groups = connected_components(links)
    of_rep = distinct.where("rep is not null").select("rep").distinct().join(groups, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component_id", "rep").alias("component_id"))
    more = materialize(verified(materialize(missing_pairs(sketched, materialize(of_rep, "found"), similarity, tile), "missing"), sketched, similarity), "similar")
    groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(more))
    to = distinct.join(groups, distinct.rep == groups.node, "left").select("fp", "own", F.coalesce("component_id", "rep").alias("component_id"))
    return sketched.select("doc_id", "fp", "own").join(to, ["fp", "own"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs with the smallest doc_id of their similar_groups, with all their columns, whatever their names.

    Which rows go is found, and written, before; the result reads docs once more. Rows without doc_id stay only if no row with an id is alike; rows of one doc_id are one document. Texts of any
    length are read whole.
    """
    name = free_name("gone_", docs)
    with last_stays(docs.sparkSession):
        groups = similar_groups(docs, similarity, shingle)
        gone = materialize(groups.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reached) of every row of docs.

    Rows of equal fingerprint are one node of the graph, so large groups of copies are counted before any
    shuffle. A null or empty text has fingerprint zero and links like any other. A null doc_id keeps a
    null id and takes part only by its fingerprint's group (component null if no row of it has an id).
    Repeated rows repeat; extra columns are ignored; texts of any length are read whole; an empty table gives none.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    groups = connected_components(fingerprint_links(distinct.where("rep is not null"), radius))
    to = distinct.join(groups, distinct.rep == groups.node, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return marked.join(to, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
