"""Ranked search, pattern packing and centroid clustering against slow versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as p
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackframe.llm import centroids, pattern_packing, ranked_search

WORDS = p.path("word_bpe_49k.json")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def key(row):
    return tuple(str(x) for x in row)


# ---- ranked search


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def slow_search(docs, items, most=20):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in terms(text).items() if c[t])
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:most], 1)]
    return out


@pytest.fixture(scope="module")
def items(spark, texts):
    rows = [(1, texts[3]), (2, texts[7][:200]), (2, "漢字 GRÜSSE grüße"), (3, None), (4, ""), (5, "nowhere at all"), (6, "x x X w1"), (None, texts[47]), (7, texts[3]), (8, " ".join(f"w{i}" for i in range(400))), (9, "Zeile\x00zwei")]
    return rows, spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "item_id long, text string, rank int, query string")


@pytest.mark.parametrize("most", [20, 3])
def test_search_equals_brute_force(docs, plain, items, most):
    got = ranked_search.search(docs, items[1], most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [r for r in plain if r[0] != 60] + [(60, None)]
    assert sorted(map(key, got.collect())) == sorted(map(key, slow_search(rows, items[0], most)))


def test_search_in_blocks_and_joined_candidates(docs, plain, items, monkeypatch):
    """Queries in several blocks, candidates joined instead of sent, small bitmaps and signatures that hold a lot of false members."""
    for name, value in (("QUERIES", 3), ("SENT", 0), ("AREA", 4096), ("BITS", 1), ("HASHES", 1)):
        monkeypatch.setattr(ranked_search, name, value)
    assert sorted(map(key, ranked_search.search(docs, items[1], 5).collect())) == sorted(map(key, slow_search(plain, items[0], 5)))


def test_search_of_nothing(spark, docs, empty, items):
    assert ranked_search.search(empty, items[1]).collect() == []
    assert ranked_search.search(docs, items[1].limit(0)).collect() == []
    assert ranked_search.search(docs, items[1].where("item_id in (3, 4, 5)")).collect() == []
    assert ranked_search.search(docs.where("doc_id in (40, 41)"), items[1]).collect() == []


def test_bounds_are_upper_bounds_and_copies_tie_by_id(spark):
    rng = random.Random(5)
    common = " ".join(f"w{rng.randrange(50)}" for _ in range(80))
    rows = [(i, common if i % 3 == 0 else " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(1, 300)))) for i in range(600)]
    asked = [(i, rows[i * 7][1]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ranked_search.search(df, spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted(map(key, got.collect())) == sorted(map(key, slow_search(rows, asked)))
    q = ranked_search.Queries([t for _, t in asked])
    (*_, sizes, width, slices, _, _) = next(iter([r for r in ranked_search.index(df.coalesce(1), q.terms).collect() if r.width]))
    q.weigh(600, 60_000, {i: 3 for i in range(len(q.terms))})
    bound, text = q.bounds(width, np.array(sizes, np.int64), slices), dict(rows)
    first = next(r for r in ranked_search.index(df.coalesce(1), q.terms).collect() if r.width == width and r.slices == slices)
    for d, doc in enumerate(first.ids):
        c = terms(text[doc])
        damp = int(q.damp(np.array([sum(c.values())]))[0])
        for k, (_, t) in enumerate(asked):
            exact = sum(r * int(q.weight[q.terms[w.encode()]]) * (1000000000 * c[w] // (1000 * c[w] + 12 * damp)) for w, r in terms(t).items() if c[w])
            assert exact <= bound[k, d]


# ---- pattern packing


def library(text):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def assert_packed(rows, window):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(at) == list(range(len(at)))
    return len(at)


@pytest.mark.parametrize("window", [4096, 64, 7])
def test_pieces_are_the_documents(docs, plain, window):
    rows = pattern_packing.pack(docs, WORDS, window, keep_ids=True).collect()
    want = []
    for d, t in plain:
        ids = [*library(t), 1]
        for k, a in enumerate(range(0, len(ids), window)):
            raw = np.array(ids[a : a + window], "<u4").tobytes()
            want.append((d, k, a, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted(key(r[:5]) + (bytes(r.ids),) for r in rows) == sorted(key(r[:5]) + (r[5],) for r in want)
    n = assert_packed(rows, window)
    assert n <= 1.15 * sum(r.length for r in rows) / window + 1


def test_packing_of_nothing(empty):
    assert pattern_packing.pack(empty, WORDS).collect() == []


HISTOGRAMS = st.dictionaries(st.integers(1, 96), st.integers(0, 400), max_size=30)


@settings(max_examples=150, deadline=None)
@given(HISTOGRAMS, st.sampled_from([96, 100, 4096]))
def test_plans_place_every_piece_once(histogram, window):
    plan = pattern_packing.Plan(dict(histogram), window)
    used = Counter()
    for n, what in plan.alike:
        assert n > 0 and sum(length * times for length, times in what) <= window
        for length, times in what:
            used[length] += n * times
    assert used == Counter({k: n for k, n in histogram.items() if n})
    for length in used:  # intervals cover the numbers of a length without gaps
        own = [r for r in plan.intervals().tolist() if r[0] == length]
        assert own[0][1] == 0 and all(a[1] < b[1] for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize(("low", "high", "over"), [(1, 4096, 1.01), (100, 2000, 1.005), (700, 2000, 1.02), (1, 60, 1.005)])
def test_plans_come_close_to_the_bound(low, high, over):
    lengths = np.random.default_rng(2).integers(low, high + 1, 60_000)
    plan = pattern_packing.Plan(dict(Counter(lengths.tolist())), 4096)
    assert sum(n for n, _ in plan.alike) <= over * math.ceil(lengths.sum() / 4096)


def test_patterns_make_most_of_a_plan():
    """The fit itself, not the rest, packs what is long: repeats are what least squares gives, and none goes below 0."""
    histogram = dict(Counter(np.random.default_rng(3).integers(600, 3000, 50_000).tolist()))
    fit = pattern_packing.fitted(histogram, 4096)
    assert sum(n for _, n in fit) > 0.8 * sum(n for n, _ in pattern_packing.Plan(histogram, 4096).alike)
    have = Counter()
    for length, n in histogram.items():
        have[-(-length // 64) * 64] += n
    for ends, n in fit:
        assert sum(ends) == 4096 and n > 0
        have.subtract({end: n * ends.count(end) for end in set(ends)})
    assert min(have.values()) >= 0


def test_least_squares_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 3, (12, 25)).astype(float), rng.normal(size=12) * 5
        x = pattern_packing.least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_hot_lengths_are_numbered_over_tasks(spark):
    """A third of all documents have one length; they lie in several partitions."""
    rows = [(i, "one two three" if i % 3 else "word " * (i % 200)) for i in range(3000)]
    out = pattern_packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), WORDS, 256).collect()
    assert len({(r.doc_id, r.piece) for r in out}) == len(out) and {r.doc_id for r in out} == set(range(3000))
    assert assert_packed(out, 256) <= 1.01 * sum(r.length for r in out) / 256 + 1


# ---- centroids


def slow_clusters(rows, clusters=16, rounds=3, size=64):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(64 * x) <= 1 << 24 for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    at = [v for _, v in start]
    near = lambda v: min((far(v, c), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        at = [tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if own[k] else c for k, c in enumerate(at)]
    done = [(i, *near(v)) for i, v in kept] if at else []
    total = Counter()
    for _, d, k in done:
        total[k] += d
    return [(i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, d, k in done]


def vectors(n, seed, size=64):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, size))
    return [(i, (middle[i % 5] + rng.normal(size=size) * 0.3).astype(np.float32).astype(float).tolist()) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = vectors(150, 1)
    odd = [(200, None), (201, [1.0] * 63), (202, [float("nan")] + [0.0] * 63), (203, [float("inf")] * 64), (204, [None] + [0.0] * 63), (205, []), (206, [0.0] * 64), (207, [-0.001] * 64), (208, [1e9] * 64), (None, rows[3][1]), (4, rows[9][1]), (5, rows[5][1]), (None, None)]
    rows += odd + [(300 + i, [0.5] * 64) for i in range(60)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(4)
    got = centroids.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(key, got.collect())) == sorted(map(key, slow_clusters(rows)))


@pytest.mark.parametrize(("clusters", "rounds", "size"), [(3, 1, 64), (30, 2, 64), (5, 3, 16), (4, 0, 64)])
def test_cluster_parameters(spark, clusters, rounds, size):
    rows = vectors(25, 2, size)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(key, centroids.cluster(df, clusters, rounds, size).collect())) == sorted(map(key, slow_clusters(rows, clusters, rounds, size)))


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(none).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(0, 10_000), st.sampled_from([1, 3, 60]))
def test_search_finds_the_nearest(n, k, seed, spread):
    rng = np.random.default_rng(seed)
    rows, cents = rng.integers(-spread, spread + 1, (n, 64)), rng.integers(-spread, spread + 1, (k, 64))
    far = ((rows[:, None] - cents[None]) ** 2).sum(2)
    cluster, distance = centroids.nearest(centroids.transform(rows), centroids.transform(cents))
    assert (cluster == far.argmin(1)).all() and (distance == 64 * far.min(1)).all()
    assert (centroids.restore(centroids.transform(rows)) == rows).all()


def test_far_centroids_leave_early():
    """A centroid that is strictly worse by its first coefficients is not measured further."""
    rows, cents = np.zeros((50, 64), np.int64), np.vstack([np.ones((1, 64), np.int64), np.full((15, 64), 40)])
    seen = []
    real = np.einsum

    def counted(how, a, b):
        seen.append(a.size)
        return real(how, a, b)

    centroids.np.einsum, (cluster, _) = counted, (None, None)
    try:
        cluster, _ = centroids.nearest(centroids.transform(rows), centroids.transform(cents))
    finally:
        centroids.np.einsum = real
    assert (cluster == 0).all() and sum(seen) < 0.5 * 50 * 16 * 64
