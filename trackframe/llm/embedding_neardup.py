"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the vectors at random directions, again and again; vectors near a split go down both
sides (spill overlap). Vectors that share a leaf of any tree are compared in double precision, and what
reaches the cosine is a link. The splits are fitted on a bounded sample; every vector goes through
every tree. Where a leaf's sample is used up before the leaf is small, the tree goes on below it: each further
level is a random direction of its own, cut at the median of the leaf's sample, so that leaves stay small at any
number of vectors. A leaf that stays large, such as thousands of near copies, is dealt out in tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import connected_components, materialize, min_labels, stream_groups, tiles

TREES, LEAF, SPILL = 6, 512, 0.015
#: Vectors the splits are fitted on, at most; directions tried for a split; the share that a split may spill.
SAMPLE, TRIES, MOST_SPILLED = 20_000, 4, 0.35
#: Levels below a leaf's sample at most, and their spill.
LEVELS, DEEP_SPILL = 30, 0.0075
#: Rows of a tile; lengths with more distinct vectors than RARE have trees of their own, all others one leaf each.
TILE, RARE = 1024, 256


def grow(unit: np.ndarray, per_row: float, rng: np.random.Generator, first: int) -> tuple[tuple, int]:
    """A tree over sample rows that stand for `per_row` vectors each: (nodes, deep), the next free leaf number.

    A node is (direction, cut, below, above) or a leaf (number, cuts along the directions of `deep`, NaN for a level
    that would spill too much); a leaf takes 2 ** levels numbers.
    """
    nodes: list = []
    deep = rng.normal(size=(LEVELS, unit.shape[1]))
    deep /= np.linalg.norm(deep, axis=1, keepdims=True)

    def node(rows: np.ndarray) -> int:
        nonlocal first
        at = len(nodes)
        nodes.append(None)
        best, size = None, len(rows) * per_row
        if size > LEAF and len(rows) >= 16:
            directions = rng.normal(size=(TRIES, unit.shape[1]))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            for d in directions:
                p = np.sort(unit[rows] @ d)
                cuts = p[int(0.3 * len(p)) : int(0.7 * len(p)) + 1]
                spilled = np.searchsorted(p, cuts + SPILL, "right") - np.searchsorted(p, cuts - SPILL)
                k = int(np.argmin(spilled))
                if best is None or spilled[k] < best[0]:
                    best = (spilled[k], d, float(cuts[k]))
        if best is None or best[0] > MOST_SPILLED * len(rows):  # small enough, used up, or too tight to part
            levels = min(LEVELS, int(np.ceil(np.log2(size / LEAF)))) if best is None and size > LEAF and len(rows) > 1 else 0
            p = unit[rows] @ deep[:levels].T
            cuts = np.median(p, 0) if levels else np.zeros(0)
            cuts[(np.abs(p - cuts) <= DEEP_SPILL).mean(0) > MOST_SPILLED] = np.nan
            nodes[at] = (first, cuts[~np.isnan(cuts)], np.flatnonzero(~np.isnan(cuts)))
            first += 1 << len(nodes[at][1])
            return at
        _, d, cut = best
        p = unit[rows] @ d
        below = node(rows[p <= cut + SPILL])
        nodes[at] = (d, cut, below, node(rows[p >= cut - SPILL]))
        return at

    node(np.arange(len(unit)))
    return (nodes, deep), first


def leaves(trees: list, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each row reaches."""
    rows_out, leaf_out = [], []
    for nodes, deep in trees:
        stack = [(0, np.arange(len(unit)))]
        while stack:
            at, rows = stack.pop()
            if not len(rows):
                continue
            if len(nodes[at]) == 3:
                number, cuts, levels = nodes[at]
                code, who = np.zeros(len(rows), np.int64), np.arange(len(rows))
                p = unit[rows] @ deep[levels].T
                for k, cut in enumerate(cuts.tolist()):
                    own = p[who, k]
                    below, above = own <= cut + DEEP_SPILL, own >= cut - DEEP_SPILL
                    code, who = np.r_[2 * code[below], 2 * code[above] + 1], np.r_[who[below], who[above]]
                rows_out.append(rows[who])
                leaf_out.append(number + code)
                continue
            d, cut, below, above = nodes[at]
            p = unit[rows] @ d
            stack += [(below, rows[p <= cut + SPILL]), (above, rows[p >= cut - SPILL])]
    return np.concatenate(rows_out), np.concatenate(leaf_out)


def unit_vectors(vec: np.ndarray) -> np.ndarray:
    """Rows over their length. A row is scaled by a power of two first, which is exact, so that no square is too large or too small."""
    scaled = np.ldexp(vec, -np.frexp(np.abs(vec).max(1, initial=0.0))[1][:, None])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(column) -> np.ndarray:
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding), whatever else it holds.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
    without vec_id (component null, not kept) or vectors of different lengths; components of any magnitude count. Equal vectors are counted as
    one node before the shuffle and link with each other; repeated rows count as vectors of their own.
    An empty table gives none. Pairs are links only at the cosine or above; a pair is found if it shares a leaf
    of one of the trees, and counted in the first of these.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.withColumn("sound", F.coalesce(sound & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    classes = materialize(v.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vectors")
    sizes = classes.groupBy(F.size("embedding").alias("size")).count().where(F.col("count") > RARE).orderBy("size").collect()
    forests, first, rng = {}, 0, np.random.default_rng(7)
    for dim, n in sizes:
        sample = classes.where(F.size("embedding") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow().column(0)
        x = unit_vectors(_vectors(sample))
        forests[dim] = []
        for _ in range(TREES):
            tree, first = grow(x, n / len(x), rng, first)
            forests[dim].append(tree)
    held = spark.sparkContext.broadcast(forests)

    def route(batches):
        import pyarrow as pa

        for whole in batches:
            lengths = whole.column(0).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                b = whole.take(pa.array(np.flatnonzero(lengths == dim)))
                if dim in held.value:
                    row, leaf = leaves(held.value[dim], unit_vectors(_vectors(b.column(0))))
                else:  # few vectors of this length: one leaf
                    row, leaf = np.arange(b.num_rows), np.full(b.num_rows, -dim)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.searchsorted(row, np.arange(b.num_rows + 1))
                paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf, pa.int64()))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *(b.column(k).take(at) for k in (1, 2)), paths.take(at), b.column(0).take(at)], ["leaf", "rep", "m", "paths", "embedding"])

    def compare(batches):
        import pyarrow as pa

        for t, starts in stream_groups(batches, ["leaf", "tile_a", "tile_b"], 4096):
            out = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                g = t.slice(lo, hi - lo)
                rep = g.column("rep").to_numpy()
                order = np.argsort(rep)
                g, rep = g.take(pa.array(order)), rep[order]
                m, chunk, leaf = g.column("m").to_numpy(), g.column("chunk").to_numpy(), g.column("leaf")[0].as_py()
                vec = unit_vectors(_vectors(g.column("embedding")))
                a_tile, b_tile = g.column("tile_a")[0].as_py(), g.column("tile_b")[0].as_py()
                ia, ib = np.flatnonzero(chunk == a_tile), np.flatnonzero(chunk == b_tile)
                near = vec[ia] @ vec[ib].T >= cosine
                if a_tile == b_tile:
                    near = np.triu(near, 1)
                a, b = (i[k] for i, k in zip((ia, ib), np.nonzero(near), strict=True))
                paths = g.column("paths").to_pylist()
                width = max(map(len, paths))
                seen = np.array([[*p, *[-1] * (width - len(p))] for p in paths])
                seen[seen >= leaf] = -1
                new = np.ones(len(a), bool)
                for k in range(0, len(a), 20_000):
                    pa_, pb_ = seen[a[k : k + 20_000]], seen[b[k : k + 20_000]]
                    new[k : k + 20_000] = ~((pa_[:, :, None] == pb_[:, None, :]) & (pa_[:, :, None] >= 0)).any((1, 2))
                links = np.bincount(a[new], m[b[new]], len(rep)) + np.bincount(b[new], m[a[new]], len(rep))
                label = min_labels(len(rep), a, b)
                to = np.flatnonzero((links > 0) | (label != np.arange(len(rep))))
                out.append((rep[to], links[to].astype(np.int64), rep[label[to]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["rep", "links", "least"])

    columns, kind = ["embedding", "rep", "m"], classes.schema["embedding"].dataType.simpleString()
    routed = materialize(classes.select(*columns).mapInArrow(route, f"leaf long, rep long, m long, paths array<bigint>, embedding {kind}"), "leaves")
    met = tiles(routed, ["leaf"], "rep", TILE).select("leaf", "tile_a", "tile_b", "chunk", "rep", "m", "paths", "embedding")
    found = materialize(met.mapInArrow(compare, "rep long, links long, least long"), "found")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    done = classes.join(counted, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    done = done.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = v.where("sound").join(done, "embedding").select("vec_id", "n_links", "component_id")
    alone = v.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
