"""SimHash, embeddings and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from trackframe.llm import common, embedding_neardup, simhash, substring_dedup


def key(r):
    return tuple(str(x) for x in r)


def reachable(ids, linked):
    """Smallest id each id reaches over linked pairs."""
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return {i: find(i) for i in ids}


def slow_fingerprint(text):
    w = [x.lower() for x in text.encode().split()]
    runs = [w[k : k + 3] for k in range(len(w) - 2)] or ([w] if w else [])
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_bit_sliced_links():
    rng = np.random.default_rng(1)
    for radius, words in ((2, 1), (9, 2)):
        sizes = rng.integers(1, 150, 12)
        starts = np.r_[0, np.cumsum(sizes)]
        n = int(starts[-1])
        fp = rng.integers(0, 2**63, (6, words)).astype(np.uint64)[rng.integers(0, 6, n)]
        for _ in range(2 * radius):
            fp[np.arange(n), rng.integers(0, words, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) * rng.integers(0, 2, n).astype(np.uint64)
        a, b = simhash.links_of(fp[:, 0] if words == 1 else fp, starts, radius)
        group = np.repeat(np.arange(12), sizes)
        near = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= radius) & (group[:, None] == group) & np.triu(np.ones((n, n), bool), 1)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)) and near.any()


def test_block_masks_lose_no_pair():
    rng = random.Random(1)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64))
        y ^= 1 << rng.randrange(64)
        assert any(x & m == y & m for m in simhash.block_masks())


def test_op3(docs, plain, empty):
    fp = [(d, slow_fingerprint(t)) for d, t in plain]
    ids = sorted({d for d, _ in fp if d is not None})
    own = {d: f for d, f in fp if d is not None}
    near = [(a, b) for a in ids for b in ids if a < b and bin(own[a] ^ own[b]).count("1") <= 2]
    to = reachable(ids, near)
    by_fp = {}
    for d in ids:
        by_fp.setdefault(own[d], to[d])
    want = [(d, f"{f:016x}", to[d] if d is not None else by_fp.get(f)) for d, f in fp]
    assert sorted(map(key, simhash.near_duplicates(docs).collect())) == sorted(map(key, want))
    assert simhash.near_duplicates(empty).count() == 0


def test_tiles_keep_every_pair_of_a_large_group(spark):
    df = spark.range(300).select(F.lit("k").alias("k"), "id").union(spark.range(300, 303).select(F.concat(F.lit("o"), "id"), "id"))
    rows = common.tiles(df, ["k"], "id", 64).collect()
    by_tile = {}
    for r in rows:
        by_tile.setdefault((r.k, r.tile_a, r.tile_b), set()).add(r.id)
    large = [s for (k, _, _), s in by_tile.items() if k == "k"]
    assert max(map(len, large)) < 200
    assert {(a, b) for s in large for a in s for b in s if a < b} == {(a, b) for a in range(300) for b in range(a + 1, 300)}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(999, i) for i in range(20)] + [(5, 5)]
    got = {r.node: r.component_id for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in [*range(20), 999]}}


def test_similar_groups(spark, empty):
    rng = random.Random(5)
    base = [[f"t{rng.randrange(5000)}" for _ in range(400)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:15]):  # two changed words: a similarity of about 0.95
        near = list(w)
        near[50], near[300] = "x", "y"
        rows.append((100 + i, " ".join(near)))
        far = list(w)
        far[::20] = ["z"] * 20  # about 0.6
        rows.append((200 + i, " ".join(far)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert all(got[100 + i] == i and got[200 + i] == 200 + i for i in range(15)) and all(got[i] == i for i in range(30))
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {*range(30), *range(200, 215)}
    assert simhash.keep_one(empty).count() == 0


def test_forest_joins_by_the_nearest_links():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = 30
        a, b = (rng.integers(0, n, 60) for _ in range(2))
        stay = a != b
        a, b, d = a[stay], b[stay], rng.integers(0, 9, stay.sum())
        own = simhash.forest(n, a, b, d)
        for most in range(9):  # the same groups at every distance
            near, mine = d <= most, d[own] <= most
            assert (common.min_labels(n, a[near], b[near]) == common.min_labels(n, a[own][mine], b[own][mine])).all()


def test_similar_groups_against_all_pairs(spark):
    """Near copies around the similarity of 0.8: no group joins what no chain of pairs at 0.8 joins, few links are missed."""
    rng, rows = random.Random(12), []
    for i in range(120):
        w = [f"t{rng.randrange(9000)}" for _ in range(300)]
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 4):
            near = list(w)
            for at in rng.sample(range(300), rng.randrange(1, 11)):
                near[at] = f"new{rng.randrange(9000)}"
            rows.append((10 * i + k, " ".join(near)))
    rows += [(5000 + k, rows[0][1]) for k in range(30)] + [(6000, ""), (6001, None), (6002, "one two"), (6003, "one two")]
    sets = {d: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for d, t in rows for w in [(t or "").split()]}
    alike = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    ids = sorted(sets)
    links = [(x, y) for x in ids for y in ids if x < y and (x // 10 == y // 10 or max(x, y) >= 5000) and alike(x, y)]
    want = reachable(ids, links)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    kept = [(x, y) for x, y in links if got[x] == got[y]]
    assert all(want[d] == want[got[d]] for d in ids)  # nothing is joined that is not alike
    assert len(kept) >= 0.97 * len(links) and got[6001] == 6000 and got[6003] == 6002 and all(got[5000 + k] == got[0] for k in range(30))


def test_keep_one_keeps_columns(docs):
    assert simhash.keep_one(docs).columns == docs.columns
    odd = docs.withColumn("gone_", F.lit(1)).withColumn("keys", F.lit(2))
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(odd).count() == simhash.keep_one(docs).count()
    ids = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert 3 in ids and 44 not in ids and 45 not in ids and 5 in ids


def test_op7(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + rng.normal(size=16) * 0.1).tolist()) for i in range(300)]
    rows += [(1000 + i, base[7].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [1.0] * 4), (2006, [2.0] * 4), (None, base[7].tolist())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = {r.vec_id: r for r in embedding_neardup.near_duplicates(df).collect()}
    sound = [(d, np.array(v, np.float32).astype(float)) for d, v in rows if d is not None and v and d not in (2002, 2003, 2004)]
    x = {d: v / np.linalg.norm(v) for d, v in sound}
    links = [(a, b) for a in x for b in x if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.95]
    count = {d: 0 for d in got}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    to = reachable([d for d in got if d is not None], links)
    for d, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == ((0, None, False) if d is None else (count[d], to[d], to[d] == d)), d
    assert embedding_neardup.near_duplicates(df.limit(0)).count() == 0


def test_op7_recall_through_the_trees(spark, monkeypatch):
    monkeypatch.setattr(embedding_neardup, "LEAF", 64)
    monkeypatch.setattr(embedding_neardup, "TILE", 32)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, (base[i] + rng.normal(size=32) * 0.2).tolist()) for i in range(600)] + [(3000 + i, (base[0] + rng.normal(size=32) * 0.05).tolist()) for i in range(100)]
    got = {r.vec_id: r.n_links for r in embedding_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {d: int(n) - 1 for (d, _), n in zip(rows, (x @ x.T >= 0.95).sum(1), strict=True)}
    assert all(got[d] <= true[d] for d in true)
    assert sum(got.values()) >= 0.9 * sum(true.values()) > 0


def test_leaves_stay_small_beyond_the_sample():
    """With a sample of few rows for very many vectors, leaves stay near LEAF and near vectors still share one."""
    rng = np.random.default_rng(3)
    for n in (20_000, 80_000):
        x = rng.normal(size=(n, 48))
        near = x[:2000] + rng.normal(size=(2000, 48)) * 0.2
        x = np.concatenate([x, near])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sample = x[rng.choice(len(x), 300, replace=False)]
        trees, first = [], 0
        for _ in range(embedding_neardup.TREES):
            tree, first = embedding_neardup.grow(sample, len(x) / len(sample), rng, first)
            trees.append(tree)
        row, leaf = embedding_neardup.leaves(trees, x)
        sizes = np.bincount(leaf)
        assert (sizes.astype(float) ** 2).sum() / sizes.sum() < 4 * embedding_neardup.LEAF  # the mean leaf a vector meets
        by_row = [set() for _ in range(len(x))]
        for r, k in zip(row.tolist(), leaf.tolist(), strict=True):
            by_row[r].add(k)
        close = [(i, n + i) for i in range(2000) if x[i] @ x[n + i] >= 0.95]
        assert len(close) > 500 and sum(bool(by_row[i] & by_row[j]) for i, j in close) >= 0.97 * len(close)


def slow_repeats(rows, window):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = t.encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (d, s))
    for (k, t) in rows:
        w = t.encode().split()
        mask = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (k, s):
                mask[s : s + window] = [True] * window
        yield k, w, mask


def test_op10(docs, plain, empty, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 5000)
    null = int(substring_dedup.NULL_ID)
    rows = [(null if d is None else d, t) for d, t in plain]
    want = [(None if k == null else k, len(w), sum(m), hashlib.sha256(b" ".join(x for x, y in zip(w, m, strict=True) if not y)).hexdigest()) for k, w, m in slow_repeats(rows, 20)]
    assert sum(r[2] for r in want) > 300
    assert sorted(map(key, substring_dedup.dedup(docs, digest=True).collect())) == sorted(map(key, want))
    assert substring_dedup.dedup(empty, digest=True).count() == 0


def test_a_phrase_in_every_document(spark, monkeypatch):
    """One 12-word phrase in all documents, whose windows differ: its anchor is hot, and the result the same."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    rng, phrase = random.Random(11), " ".join(f"common{k}" for k in range(12))
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{some(15)} {phrase} {some(15)}") for i in range(300)]
    rows += [(1000 + i, some(5) + " " + rows[i][1][20:] + " " + some(3)) for i in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = substring_dedup.hot_anchors(docs.selectExpr("cast(text as binary) as text"), 20)
    assert len(hot) and (np.diff(hot.astype(object)) > 0).all() and len(substring_dedup.hot_anchors(docs.selectExpr("cast(text as binary) as text"), 20, 1)) == 1
    want = {k: (len(w), sum(m)) for k, w, m in slow_repeats(rows, 20)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup(docs, digest=True).collect()}
    assert got == want and sum(m for _, m in want.values()) > 1000
    # The windows of a hot anchor are dealt to many buckets.
    hashed = [r for r in substring_dedup.index_block([(d, t.encode()) for d, t in rows], 20, 64, hot)]
    plain = [r for r in substring_dedup.index_block([(d, t.encode()) for d, t in rows], 20, 64, hot[:0])]
    most = lambda parts: max(sum(len(p.get("low", ())) for b, p in parts if b == own) for own in range(64))
    assert most(hashed) * 3 < most(plain)


def test_what_is_frequent_over_all_blocks_only_is_hot(spark, monkeypatch):
    """A phrase with some ten windows in each of 500 blocks is found, and dealt out; words that are as frequent in one block are not."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1)  # a text is a block
    rng, phrase = random.Random(3), " ".join(f"common{k}" for k in range(12))
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{some(15)} {phrase} {some(15)}" for _ in range(500)]
    hot = substring_dedup.hot_anchors(spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(4), 20)
    assert 1 <= len(hot) <= 6
    anchors = [set(substring_dedup.window_hashes(substring_dedup.hashed_words([t.encode()])[0], 20)[0].tolist()) for t in texts]
    assert all(any(a in own for own in anchors[:50]) for a in hot.tolist()) and sum(not set(hot.tolist()).isdisjoint(own) for own in anchors) > 400
    where = {b for i, t in enumerate(texts) for b, _ in substring_dedup.index_block([(i, t.encode())], 20, 64, hot)}
    assert len(where) == 64


def test_spans_of_factors_cover_the_repeated_windows():
    """What the factors and the checks at their ends cover is what windows found earlier cover."""
    rng = random.Random(2)
    for _ in range(200):
        n, window, pos, runs = 120, 5, 0, []
        while pos < n - window:
            pos += rng.randrange(0, 9)
            length = rng.randrange(1, 12)
            if pos + length + window - 1 > n:
                break
            runs.append((pos, length, rng.randrange(3), rng.randrange(50)))
            pos += length
        factors, spans = substring_dedup.parse(dict(zip(("pos", "length", "src_id", "src_pos"), zip(*runs, strict=True), strict=True)) if runs else {k: () for k in ("pos", "length", "src_id", "src_pos")}, window)
        want = {w for p, k, _, _ in runs for w in range(p, p + k + window - 1)}
        assert {w for a, b in spans for w in range(a, b)} == want
        assert all(f[1] >= window for f in factors) and all(a[0] + a[1] <= b[0] for a, b in zip(factors, factors[1:], strict=False))
        words = [str(i) for i in range(n)]
        assert substring_dedup.kept_words(words, spans) == [w for i, w in enumerate(words) if i not in want]


def test_op10_tells_windows_of_one_anchor_apart(spark, monkeypatch):
    """Two texts around one shared run whose window hashes agree in their low 32 bits, found among many, are no repeat."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1)
    shared, n = [f"s{k}" for k in range(19)], 300_000
    h = np.empty((n, 20), np.uint64)
    h[:, 0] = [xxhash.xxh64_intdigest(f"x{i}".encode()) for i in range(n)]
    h[:, 1:] = [xxhash.xxh64_intdigest(w.encode()) for w in shared]
    anchor, whole = (a[::20] for a in substring_dedup.window_hashes(h.ravel(), 20))
    anchors, times = np.unique(anchor, return_counts=True)
    own = np.flatnonzero(anchor == anchors[times.argmax()])
    seen, alike = {}, []
    for i in own.tolist():
        alike += [(j, i)] if (j := seen.setdefault(int(whole[i]) & 0xFFFFFFFF, i)) != i else []
    assert alike
    rows = [(2 * k + m, " ".join([f"x{i}", *shared, f"end{k}{m}"])) for k, pair in enumerate(alike[:1]) for m, i in enumerate(pair)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    # The 19 shared words stay too: no 20 words of the two texts are equal.
    assert [r.n_removed for r in got] == [0, 0]


def test_factors_are_copies_and_columns_stay(docs, plain):
    got = substring_dedup.dedup(docs)
    assert [c for c in got.columns if c not in ("n_words", "n_removed", "factors")] == [c for c in docs.columns if c != "n_words"]
    text = {(int(substring_dedup.NULL_ID) if d is None else d): t.split() for d, t in plain if d is not None}
    for r in got.where("doc_id is not null and n_removed > 0").collect():
        for f in r.factors:
            if f.src_id in text:
                assert text[r.doc_id][f.start : f.start + f.words] == text[f.src_id][f.src_start : f.src_start + f.words] and f.words >= 20
                assert (f.src_id, f.src_start) < (r.doc_id, f.start)
    plain_out = substring_dedup.dedup(docs, report=False)
    assert plain_out.columns == docs.columns
    assert {r.doc_id: r.text for r in plain_out.collect()}[41] == " \n\t " and plain_out.where("doc_id = 60").first().text is None


def test_vectors_of_many_lengths_and_magnitudes(spark, monkeypatch):
    """Twelve lengths, all common or none, and components whose squares are no doubles: as by brute force, on vectors scaled to 1."""
    rng = np.random.default_rng(12)
    rows = []
    for dim in range(2, 14):
        middle = rng.normal(size=(12, dim))
        for k in range(48):
            v = middle[k % 12] + rng.normal(size=dim) * (0.02 if k < 24 else 0.4)
            rows.append((len(rows), (v * 10.0 ** rng.choice([0, 200, -200, 307, -300])).tolist()))
    rows += [(len(rows) + k, v) for k, v in enumerate([[0.0] * 5, [5e-324, 0.0], [1e308, 0.0], [1.7e308] * 3, [1e-310] * 3, [], None])]
    units = [None if not v or not any(v) else (lambda x: x / np.linalg.norm(x))(np.array(v) / np.abs(v).max()) for _, v in rows]
    links = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95] for i, a in enumerate(units)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in own)]) for i, own in enumerate(links)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for rare in (256, 20):
        monkeypatch.setattr(embedding_neardup, "RARE", rare)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_neardup.near_duplicates(df).collect()}
        assert got == {i: (len(own), label[i]) for i, own in enumerate(links)}
    assert len(links[-6]) + len(links[-5]) > 0


def test_similar_groups_lose_no_link_at_the_threshold(spark):
    """500 pairs of exactly 0.8 (40 of 50 shingles), each with no other text alike; a passage that all pairs share stands in some texts."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, rows = words(60), []
    for i in range(500):
        x = words(44)
        rows += [(2 * i, " ".join(x + words(5))), (2 * i + 1, " ".join(x + words(5)))]
    rows += [(2000 + i, " ".join(words(30) + common)) for i in range(60)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [i for i in range(500) if got[2 * i + 1] != 2 * i] == []
    assert all(got[d] == d for d in range(2000, 2060))


def test_sets_alike_share_their_first_shingles():
    """Of sets of any size, those of 0.8 or more share as many of their first shingles as least_shared tells; unrelated sizes and few shingles too."""
    rng, tight = np.random.default_rng(7), 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 10**6, n))
        y = np.union1d(x[rng.random(len(x)) < rng.uniform(0.75, 1)], rng.integers(0, 10**6, int(rng.integers(0, n // 5 + 2))))
        shared = len(np.intersect1d(x, y))
        if not len(y) or shared < 0.8 * (len(x) + len(y) - shared) - 1e-9:
            continue
        sizes = np.array([len(x)]), np.array([len(y)])
        first = len(np.intersect1d(x[: simhash.must_share(sizes[0], 0.8)[0]], y[: simhash.must_share(sizes[1], 0.8)[0]]))
        least = int(simhash.least_shared(*sizes, 0.8)[0])
        assert first >= least >= 1
        tight += first == least > 1
    assert tight > 20


def test_pairs_that_share_a_passage_are_not_checked(spark, monkeypatch):
    """120 texts share 25 of 120 words, so all 7140 pairs meet, none is alike: few may be checked by their shingles, and those of 0.8 are among them."""
    rng, checked = random.Random(22), []
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(25)
    rows = [(i, " ".join(words(95) + passage)) for i in range(120)]
    x = words(44)
    rows += [(1000, " ".join(x + words(5))), (1001, " ".join(x + words(5))), (1001, "another text of this id")]
    verified = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda links, *rest: (checked.append(links.count()), verified(links, *rest))[1])
    got = {(r.doc_id, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, i) for i in range(120)} | {(1000, 1000), (1001, 1000)}, sorted(got)[-5:]
    assert sum(checked) < 20


def test_pairs_in_tiles_meet_once_a_shingle():
    """Two groups, one of them dealt in tiles of two chunks: every pair of other components is told as often as it shares a key."""
    rep, component, chunk = np.array([1, 2, 3, 4, 1, 2, 4]), np.array([1, 1, 3, 4, 1, 1, 4]), np.array([0, 0, 1, 1, 0, 0, 0])
    one, starts, size = np.array([False] * 4 + [True] * 3), np.array([0, 4, 7]), np.full(7, 30)
    for most in (1, 3, 1000):
        times = {}
        for a, b, met, least in simhash.pairs_that_meet(rep, component, size, chunk, one, starts, 0.8, most):
            for p, q, n in zip(a.tolist(), b.tolist(), met.tolist(), strict=True):
                times[p, q] = times.get((p, q), 0) + n
            assert set(least.tolist()) == {4}
        assert times == {(1, 3): 1, (2, 3): 1, (1, 4): 2, (2, 4): 2}


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(8)
    for n in (0, 1, 30, 700, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            x = np.unique(rng.integers(0, 2**32, n, dtype=np.uint32))
            y = np.union1d(x[rng.random(len(x)) < share], rng.integers(0, 2**32, n // 9, dtype=np.uint32))
            bits = [int.from_bytes(simhash.parities(h), "little") for h in (x, y)]
            assert (bits[0] ^ bits[1]).bit_count() <= len(np.setxor1d(x, y))


def test_unlike_rows_of_a_crowded_key_make_no_pair():
    """A key of 400 rows: 300 of one component, 100 others, all 0.6 alike but for two pairs at 0.8; one row brings no bits, so its pairs stay."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**32, 75, dtype=np.uint32)
    sets = [np.r_[base, rng.integers(0, 2**32, 25, dtype=np.uint32)] for _ in range(400)]
    for k in (0, 310):  # 89 of 111 shingles
        sets[k + 1] = np.r_[sets[k][:89], rng.integers(0, 2**32, 11, dtype=np.uint32)]
    component = np.r_[0, 1, np.full(298, 2), np.arange(300, 400)]
    of = lambda bits: {(int(a), int(b)) for found in simhash.pairs_that_meet(np.arange(400), component, np.full(400, 100), np.zeros(400, int), np.ones(400, bool), np.array([0, 400]), 0.8, 10_000, bits) for a, b in zip(*found[:2], strict=True)}
    bits = [simhash.parities(h) for h in sets]
    assert of(bits) == {(0, 1), (310, 311)}
    every = {(a, b) for a in range(400) for b in range(a + 1, 400) if component[a] != component[b]}
    assert of(None) == every
    assert of([*bits[:399], None]) == {(0, 1), (310, 311)} | {(a, 399) for a in range(399)}


def test_rows_that_meet_do_not_grow_with_the_square(spark, monkeypatch):
    """200 near copies, each pair 0.6 to 0.7 alike, so no two are one group: nearly none of the 19,900 pairs is made, those of 0.8 are; also where ids repeat."""
    rng, made = random.Random(23), []
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(120)
    rows = [(i, " ".join(base + words(25))) for i in range(200)]
    x = words(44)
    rows += [(1000, " ".join(base[:90] + x + words(5))), (1001, " ".join(base[:90] + x + words(5))), (1002, " ".join(base + words(25))), (1002, " ".join(base + words(25)))]
    plain = DataFrame.mapInArrow

    def counted(self, run, schema, *more):
        out = plain(self, run, schema, *more)
        if "least" in schema:
            made.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    got = {(r.doc_id, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, i) for i in range(200)} | {(1000, 1000), (1001, 1000), (1002, 1002)}
    assert sum(made) < 2000, made
