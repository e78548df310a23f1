"""Small hand-written cases and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackframe.functions import sequences as s
from trackframe.operators import dist, ensembles, experiments, intervals, losses, metrics, splits, targets, variants
from trackframe.sources import readers, writers


def value(spark, column, **given_):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in given_.items())).select(column.alias("v")).first()["v"]


def test_reverse_complement(spark):
    assert value(spark, s.reverse_complement(F.col("q")), q="ATCGNatcg") == "cgatNCGAT"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ACGTN", min_size=1, max_size=30), min_size=1, max_size=20))
def test_sequence_round_trips(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    q = F.col("q")
    for t, twice, back, moved in df.select("q", s.reverse_complement(s.reverse_complement(q)), s.decode_one_hot(s.one_hot(q)), s.shift_sequence(s.shift_sequence(q, F.lit(2)), F.lit(-2))).collect():
        assert twice == t
        assert back == t
        assert moved[: max(0, len(t) - 2)] == t[: max(0, len(t) - 2)] and len(moved) == len(t)


def test_windows(spark):
    bed = spark.createDataFrame([("chr1", 3, 8), ("chr1", 0, 4), ("chr1", -5, -2)], "chrom string, start long, end long")
    assert [(r.mid, r.win_start, r.win_end) for r in intervals.center_windows(bed, 10).collect()] == [(5, 0, 10), (2, -3, 7), (-4, -9, 1)]
    assert intervals.per_base_windows(spark.createDataFrame([("c", 5, 5)], bed.schema), 4).count() == 0


def test_fetched_window_starts_with_n(spark):
    tiles = readers.reference_tiles(spark.createDataFrame([("c", "acgtacgtac")], "chrom string, seq string"), 4)
    w = spark.createDataFrame([(1, "c", -3, 7), (2, "c", 6, 14), (3, "c", 20, 24)], "row_id long, chrom string, start long, end long")
    assert {r.row_id: r.seq for r in dist.fetch_windows(w, tiles, 4).collect()} == {1: "NNNACGTACG", 2: "GTACNNNN", 3: "NNNN"}


def test_metrics_of_constants(spark):
    obs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 2.0), ("b", 2.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 2.0), ("c", 2.0, 3.0), ("c", 3.0, 5.0)], "target string, y_true double, y_pred double")
    got = {r.target: r for r in metrics.by_target(obs, ["target"]).collect()}
    assert got["a"].pearsonr == 0
    assert got["b"].pearsonr is None and got["b"].r2 is None
    assert got["c"].r2 == pytest.approx(-2.0)
    genes = {r.target: r for r in metrics.by_gene(obs, "target").collect()}
    assert genes["a"].pearsonr is None and genes["a"].constant and genes["c"].r2 == -1.0


def test_strand_groups(spark):
    rows = [(0, "A+", 1), (1, "A-", 0), (2, "B", 2), (3, "C+", 4), (4, "C-", 3)]
    df = spark.createDataFrame(rows, "target_idx long, identifier string, strand_pair long")
    assert [r.group_id for r in targets.strand_groups(df).orderBy("target_idx").collect()] == [0, 0, 1, 2, 2]
    assert [r.strand for r in targets.collapse_strand_targets(df).orderBy("target_idx").collect()] == ["+", ".", "+"]


def test_natural_order(spark):
    df = spark.createDataFrame([("10.h5",), ("2.h5",), ("0.h5",)], "name string")
    assert {r.name: r.idx for r in dist.natural_index(df, "name").collect()} == {"0.h5": 0, "2.h5": 1, "10.h5": 2}
    assert writers.natural_columns(["target_10", "target_1", "target_2"]) == ["target_1", "target_2", "target_10"]


def test_exact_targets_in_pivot(spark):
    df = spark.createDataFrame([("g", 1, 0, 1.0), ("g", 10, 0, 5.0), ("g", 1, 1, 3.0)], "gene_id string, target_idx int, seed int, y_pred double")
    r = ensembles.pivot_predictions(df, [1, 10], [0, 1]).first()
    assert r.target_1_mean == 2 and r.target_10_mean == 5 and r.target_1_std == 1


def test_epoch_line_keeps_signs(spark):
    line = "Epoch 6 - 55s - train_loss: 0.5528 - train_r: -0.0007 - train_r2: -0.1 - valid_loss: 0.6 - valid_r: 0.0001 - valid_r2: 1e-4 best!"
    r = experiments.parse_epoch_lines(spark.createDataFrame([(line, "a"), ("no epoch", "a")], "value string, run string")).collect()
    assert len(r) == 1 and (r[0].epoch, r[0].secs, r[0].train_r, r[0].valid_r2, r[0].best) == (6, 55, -0.0007, 1e-4, True)


def test_random_split_is_exact(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    a = splits.split_random(df, "k", 0.8, 0.1, 0.1, 3)
    assert {r["split"]: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 8, "valid": 1, "test": 1}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, splits.split_random(df.repartition(3), "k", 8, 1, 1, 3).collect()))
    assert splits.split_violations(a, "k").count() == 0


def test_param_grid(spark):
    r = experiments.parse_param_grid(spark.createDataFrame([("p", "8, 15, x, 1.5, 1e-4, 2.0")], "path string, text string")).orderBy("place").collect()
    assert [(x.value, x.kind) for x in r] == [("8", "int"), ("15", "int"), ("x", "string"), ("1.5", "double"), ("1e-4", "string"), ("2", "int")]


def test_shuffle_variants_keep_composition(spark):
    df = spark.createDataFrame([(1, "ACGTTGCAACGTGG")], "seq_id long, seq string")
    rows = s.shuffle_variants(df, 3, 9, 6, 4, "mono").collect()
    assert len(rows) == 24 and all(sorted(r.mut_seq) == sorted("ACGTTGCAACGTGG") for r in rows)
    assert all(len(r.mut_seq) == 14 for r in s.shuffle_variants(df, 3, 9, 6, 4, "dinuc").collect())


def test_tiled_joins_equal_plain_joins(spark):
    import random

    random.seed(2)
    a = [(i, "c", x := random.randint(0, 9000), x + random.randint(1, 6000)) for i in range(60)]
    b = [(i, "c", x := random.randint(0, 9000), x + random.randint(1, 6000)) for i in range(60)]
    kind = "row long, chrom string, start long, end long"
    for mode, test in (("overlap", lambda w, f: w[2] < f[3] and f[2] < w[3]), ("endpoint", lambda w, f: w[2] <= f[2] <= w[3] or w[2] <= f[3] <= w[3])):
        got = sorted((r.w_row, r.f_row) for r in dist.overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), mode, 1000).collect())
        assert got == sorted((w[0], f[0]) for w in a for f in b if test(w, f))


def test_weights_below_one_are_an_error():
    with pytest.raises(ValueError, match="weight_range"):
        losses.position_weight(None, 8, 0.5)


def test_two_output_axes_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k long, x array<double>")
    with pytest.raises(Exception, match="axes"):
        ensembles.score_batches(df, {"m": lambda x: x[:, :, None]}, "k", "x").collect()


def test_score_transform_is_null_below_zero(spark):
    assert value(spark, targets.score_transform(F.lit(-5.0))) is None
    assert value(spark, targets.score_transform(F.lit(1.0), F.lit(3.0), log_odds=True)) == pytest.approx(math.log(0.5 + 1e-6))


def test_empty_split_is_an_error(spark, tmp_path):
    writers.write_tsv(spark.createDataFrame([(1, "train")], "gene_idx long, split string"), f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="no rows"):
        readers.scan_targets(spark, f"file://{tmp_path}/t", "gene_idx long, split string", "test")


def test_one_hot_queries_read_whole_sequences(spark, sf_dir):
    from trackframe.plans import queries, views

    letters = views.seqs(spark, sf_dir).selectExpr("sum(length(seq))").first()[0]
    assert letters > 100 * views.seqs(spark, sf_dir).count()
    for name in ("seq2_one_hot_whole", "seq5_one_hot_rc_whole"):
        got = queries.queries()[name](spark, sf_dir).selectExpr("count(*)", "min(pos)", "max(pos)").first()
        assert tuple(got)[:2] == (4 * letters, 0) and got[2] >= 100, name


def test_early_stop_stream_reads_files_dealt_by_run(spark, sf_dir, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from trackframe.plans import queries, table_queries

    monkeypatch.setattr(table_queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    assert queries.queries()["str3_stream_early_stop"](spark, sf_dir).count() > 0
    at = spark.read.parquet(f"{tmp_path}/epochs").select("run", F.input_file_name().alias("file")).distinct().collect()
    assert len(at) <= 3 * len({r.run for r in at}) and len({r.file for r in at}) > 1


def test_missing_tiles_and_values(spark):
    """A tile that is missing gives N in its place; rows without one of both values count in no sum; helper names clash with none."""
    from trackframe.operators import dist, joins, metrics

    tiles = spark.createDataFrame([("c", 0, "AAAA"), ("c", 2, "CCCC"), ("c", 3, "GG")], "chrom string, tile_idx long, seq string")
    windows = spark.createDataFrame([(1, "c", 0, 12), (2, "c", -2, 6), (3, "c", 10, 18), (4, "d", 0, 3)], "row_id long, chrom string, start long, end long")
    got = {r.row_id: r.seq for r in dist.fetch_windows(windows, tiles, 4).collect()}
    assert got == {1: "AAAANNNNCCCC", 2: "NNAAAANN", 3: "CCGGNNNN", 4: "NNN"}
    obs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.5), ("a", 9.0, None), ("a", None, 90.0)], "target string, y_true double, y_pred double")
    row = metrics.by_target(obs, ["target"]).first()
    assert row.n == 3 and 0.99 < row.pearsonr < 1
    gene = metrics.by_gene(obs.withColumnRenamed("target", "gene_idx")).first()
    assert abs(gene.pearsonr - row.pearsonr) < 1e-9
    assert metrics.spearman_by_gene(obs.withColumnRenamed("target", "gene_idx")).first().spearmanr == pytest.approx(1.0)
    odd = spark.createDataFrame([(i, "p", "x") for i in range(20)], "id long, rank_bucket_ string, bucket_ string")
    ranked = dist.rank_within(odd, ["rank_bucket_"], "id")
    assert ranked.columns == [*odd.columns, "rank"] and sorted(r["rank"] for r in ranked.collect()) == list(range(1, 21))
    with pytest.raises(ValueError):
        joins.features_with_labels(odd.select("id"), odd.select("id").limit(3), "id")


def test_repeated_windows_are_fetched_each(spark):
    """Equal lines over two tiles give equal rows; other columns, null places and strands are kept; empty intervals give ''."""
    from trackframe.operators import dist

    tiles = spark.createDataFrame([("c", 0, "A" * 128), ("c", 1, "C" * 100)], "chrom string, tile_idx long, seq string")
    rows = [(1, "c", 100, 160, "+", "x"), (1, "c", 100, 160, "+", "y"), (1, "c", 100, 160, "-", "x"), (1, "c", 100, 160, "+", "x"), (2, None, 1, 5, "+", "z"), (3, "c", 7, 7, "-", "z"), (4, "c", None, 5, "+", "z"), (5, "c", 220, 232, "-", "w")]
    windows = spark.createDataFrame(rows, "row_id long, chrom string, start long, end long, strand string, tile_idx string").repartition(3)
    got = dist.fetch_windows(windows, tiles, 128, strand="strand")
    assert got.columns == [*windows.columns, "seq"]
    seq = {1: "A" * 28 + "C" * 32, 2: None, 3: "", 4: None, 5: "CCCCCCCC" + "NNNN"}
    want = [(*r, s.strip() if (s := seq[r[0]]) is not None and r[4] == "+" else s and s[::-1].translate(str.maketrans("ACGT", "TGCA"))) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_only_needed_tiles_are_shuffled(spark):
    """Tiles are held against the tiles that windows need before they are dealt out by chromosome and tile."""
    from trackframe.operators import dist

    tiles = readers.reference_tiles(spark.createDataFrame([("c", "ACGT" * 5000)], "chrom string, seq string"), 10)
    windows = spark.createDataFrame([(i, "c", i, i + 25) for i in range(5)], "row_id long, chrom string, start long, end long")
    plan = dist.fetch_windows(windows, tiles, 10)._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("tile_seq")]
    assert "BroadcastHashJoin [mark" in plan and "LeftSemi" in plan and "Window" not in scan
    mark = lambda df: df.select(F.pmod(F.xxhash64("chrom", F.col("tile_idx").cast("long")), F.lit(dist.TILE_HASHES)).alias("m"))
    need = mark(spark.createDataFrame([("c", i) for i in range(3)], "chrom string, tile_idx long"))
    assert mark(tiles).join(need, "m", "left_semi").count() < 10


def test_long_intervals_lie_in_few_bins(spark):
    import random

    from trackframe.operators import dist

    kind = "row long, chrom string, start long, end long"
    rng = random.Random(3)

    def some(n, longest):
        return [(i, rng.choice("cd"), x := rng.randint(-(10**7), 10**8), x + int(10 ** rng.uniform(0, longest))) for i in range(n)]

    a, b = some(150, 8), [*some(150, 9), (900, "c", 5, 5), (901, "d", None, 7), (902, None, 1, 9), (903, "c", 0, 10**8)]
    wide = spark.createDataFrame(b, kind)
    levels = spark.createDataFrame([(list(range(dist.LEVELS)),)], "levels array<int>")
    dealt = dist._bins(wide.where("end > start").selectExpr("row", "start AS y_from", "end AS y_to").withColumn("y_level", dist.level_of(F.col("y_to") - F.col("y_from"), 4096)), "y", levels, 4096)
    assert max(r["count"] for r in dealt.groupBy("row").count().collect()) <= 2 * dist.LEVELS
    meets = {"overlap": lambda w, f: w[2] < f[3] and f[2] < w[3] and f[2] < f[3], "endpoint": lambda w, f: w[2] <= f[2] <= w[3] or w[2] <= f[3] <= w[3]}
    for mode, test in meets.items():
        got = dist.overlap_join(spark.createDataFrame(a, kind), wide, mode).select("w_row", "f_row").collect()
        full = [(w[0], f[0]) for w in a for f in b if w[1] == f[1] and f[2] is not None and test(w, f)]
        if mode == "endpoint":
            full += [(w[0], 901) for w in a if w[1] == "d" and w[2] <= 7 <= w[3]]
        assert sorted(map(tuple, got)) == sorted(full), mode


def test_overlap_totals_equal_the_pairs_totals(spark):
    import random

    from trackframe.operators import dist

    rng = random.Random(4)

    def some(n, longest):
        return [(i % 40, rng.choice("cd"), x := rng.randint(-300, 3000), x + int(10 ** rng.uniform(0, longest))) for i in range(n)]

    a = [*some(120, 2), (7, "c", 50, 50), (8, None, 0, 9), (9, "d", 4, None), (None, "c", 10, 90)]
    b = [*some(80, 4), (50, "c", 90, 95), (51, "c", 60, 60), (52, None, 0, 10**6), (53, "d", None, 9), (54, "d", 10**9, 10**9 + 1), (None, "d", 0, 99)]
    kind = "row long, chrom string, start long, end long"
    want = {}
    for w in a:
        for f in b:
            if None not in (*w[1:], *f[1:]) and w[1] == f[1] and w[2] < f[3] and f[2] < w[3] and w[2] < w[3] and f[2] < f[3]:
                n, rows, first = want.get(f[0], (0, 0, w[2]))
                want[f[0]] = (n + 1, rows + (w[0] or 0), min(first, w[2]))
    got = dist.overlap_totals(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["row"], {"rows": "row"})
    assert got.columns == ["row", "n", "rows", "first"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and len(want) > 30
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "NestedLoop" not in plan


def test_crowded_short_intervals_share_small_bins(spark):
    """A bin holds about what overlaps, not thousands of short intervals side by side."""
    import inspect

    from trackframe.operators import dist

    size = inspect.signature(dist.overlap_join).parameters["size"].default
    rows = spark.range(20_000).selectExpr("id AS row", "id * 5 % 100000 AS y_from", "id * 5 % 100000 + 75 AS y_to").withColumn("y_level", dist.level_of(F.col("y_to") - F.col("y_from"), size))
    levels = spark.createDataFrame([([0, 1, 2],)], "levels array<int>")
    dealt = dist._bins(rows, "y", levels, size)
    assert max(r["count"] for r in dealt.groupBy("y_on", "y_bin").count().collect()) <= 300


def test_crowded_pairs_take_few_bytes(spark, tmp_path):
    """Pairs grow with both tables' density; their features repeat from window to window, in files too."""
    import random

    from trackframe.operators import dist

    rng = random.Random(6)
    a = [(i, "c", x := rng.randint(0, 2000), x + rng.randint(1, 500)) for i in range(900)]
    b = [(i, "c", x := rng.randint(-200, 2500), x + rng.randint(51, 100)) for i in range(4000)]
    b += b[:40]  # repeated features have pairs of their own
    kind = "row long, chrom string, start long, end long"
    for mode, test in (("overlap", lambda w, f: w[2] < f[3] and f[2] < w[3]), ("endpoint", lambda w, f: w[2] <= f[2] <= w[3] or w[2] <= f[3] <= w[3])):
        out = tmp_path / mode
        dist.overlap_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), mode).write.parquet(f"file://{out}")
        got = spark.read.parquet(f"file://{out}").groupBy("w_row").agg(F.sort_array(F.collect_list("f_row")).alias("rows")).collect()
        want = {w[0]: sorted(f[0] for f in b if test(w, f)) for w in a}
        assert {r.w_row: r.rows for r in got} == want
        assert sum(p.stat().st_size for p in out.glob("*.parquet")) < 2 * sum(map(len, want.values())), mode


def test_ends_are_joined_with_one_reading_of_the_features(spark):
    from trackframe.operators import dist

    w = spark.createDataFrame([("c", 0, 9)], "chrom string, start long, end long")
    f = spark.range(9).selectExpr("'c' AS chrom", "id AS start", "id + 5 AS end", "id % 3 AS kind").distinct()
    met = dist.overlap_join(w, f, "endpoint")
    assert met._jdf.queryExecution().optimizedPlan().toString().count("% 3)") == 1
    assert met.count() == 9


def test_tracks_with_other_genes_are_an_error(spark, tmp_path):
    kind = "gene_idx long, bins array<float>"
    for name, genes in (("h5_0", range(6)), ("h5_2", range(6)), ("h5_10", [0, 1, 2, 3, 4, 9])):
        spark.createDataFrame([(g, [1.0]) for g in genes], kind).write.parquet(f"file://{tmp_path}/tracks/{name}")
    with pytest.raises(ValueError, match=r"2 with 6 genes \(h5_0, h5_2\); 1 with 6 genes \(h5_10\)"):
        readers.scan_tracks(spark, f"file://{tmp_path}/tracks")
    assert readers.scan_tracks(spark, f"file://{tmp_path}/tracks", check=False).count() == 18


def test_labels_that_lack_genes_are_an_error(spark):
    from trackframe.operators import joins

    f = spark.createDataFrame([(1, "a"), (2, "b")], "gene_idx long, x string")
    assert joins.features_with_labels(f, f.withColumnRenamed("x", "y")).count() == 2
    for other, told in (([(1, "a")], "2 rows of features for 1"), ([(1, "a"), (3, "c")], "2 keys without"), ([(1, "a"), (None, "c")], "2 keys without")):
        with pytest.raises(ValueError, match=told):
            joins.features_with_labels(f, spark.createDataFrame(other, "gene_idx long, y string"))


def test_edited_bases_are_counted_in_the_same_pass(spark):
    rows = [(1, "ACGT", 1, "G"), (2, "ACGT", 1, "n"), (3, "ACGT", 4, "A"), (4, "ACGT", -1, None), (5, None, 0, "C")]
    df, seen = s.set_bases_counted(spark.createDataFrame(rows, "id long, seq string, p int, b string"), F.col("p"), F.col("b"), "out")
    assert {r.id: r.out for r in df.collect()} == {1: "AGGT", 2: None, 3: None, 4: None, 5: None}
    assert seen.get == {"rows": 5, "invalid_letters": 2, "outside": 3}


@settings(max_examples=6, deadline=None)
@given(st.text("ACGTN", min_size=1, max_size=12), st.lists(st.integers(-15, 15), min_size=1, max_size=5))
def test_encoded_shifts_agree(spark, text, shifts):
    """The packed form, the long form and the shifted letters give the same rows."""
    df = spark.createDataFrame([(i, text, k) for i, k in enumerate(shifts)], "seq_id long, seq string, by int").withColumn("n", F.length("seq"))
    packed = {r.seq_id: r.rows for r in df.select("seq_id", s.shift_packed(s.one_hot(F.col("seq")), F.col("by"), 0.25).alias("rows")).collect()}
    long = {(r.seq_id, r.pos, r.base): r.value for r in s.shift_table(s.one_hot_table(df, keep=("by", "n")), "by", "n").collect()}
    assert len(long) == 4 * len(text) * len(shifts)
    for i, k in enumerate(shifts):
        for p in range(len(text)):
            letter = text[p - k] if 0 <= p - k < len(text) else None
            want = [0.25] * 4 if letter is None else [float(letter == b) for b in "ACGT"]
            assert packed[i][p] == want == [long[i, p, b] for b in range(4)]


def test_sampled_letters_are_bases(spark):
    df = spark.createDataFrame([(1, "ACGTNNNN.x"), (2, "NNNN")], "seq_id long, seq string")
    rows = {r.seq_id: r.rows for r in df.select("seq_id", s.one_hot_sampled(F.col("seq"), F.col("seq_id"), 3).alias("rows")).collect()}
    assert rows[1][:4] == [[float(i == b) for b in range(4)] for i in range(4)] and rows[1][8] == [0.0] * 4
    assert all(sum(r) == 1 for i in (4, 5, 6, 7, 9) for r in [rows[1][i]]) and all(sum(r) == 1 for r in rows[2])


def test_window_variants_are_the_sequences_near_the_change(spark):
    text = "ACGTNacgtAC"
    for reach in (0, 2, 50):
        got = {(r.pos, r.base): r for r in s.window_variants(spark.createDataFrame([(1, text)], "seq_id long, seq string"), reach).collect()}
        assert len(got) == 30
        for (p, b), r in got.items():
            low, up = max(0, p - reach), text.upper()
            assert (r.ref, r.wild, r.mutant) == (up[p], up[low : p + reach + 1], (up[:p] + b + up[p + 1 :])[low : p + reach + 1])


def test_window_variants_of_a_range_over_pieces(spark):
    texts = {1: "ACGTNACCGGTTTGA" * 40, 2: "ACG", 3: "A" * s.PIECE, 4: "", 5: None, 6: "C" * (s.PIECE + 1)}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, seq string")
    for start, end in ((0, None), (10, 14), (s.PIECE - 2, s.PIECE + 2), (s.PIECE, 2 * s.PIECE), (2 * s.PIECE + 5, None), (5000, 5001)):
        got = sorted((r.seq_id, r.pos, r.base, r.wild, r.mutant) for r in s.window_variants(df, 3, start, end).collect())
        want = [
            (i, p, b, t[max(0, p - 3) : p + 4], (t[:p] + b + t[p + 1 :])[max(0, p - 3) : p + 4])
            for i, t in texts.items() if t for p in range(start, min(len(t), end or len(t))) if t[p] in "ACGT" for b in "ACGT" if b != t[p]
        ]
        assert got == sorted(want)


def test_window_shuffles_are_the_shuffled_sequences_near_the_position(spark):
    texts = {1: "ACGTNACCGGTTTGA" * 20, 2: "ACGTA", 3: "G", 4: "", 5: None}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, seq string")
    for mode, reach, start, end in (("random", 0, 0, 400), ("mono", 4, s.PIECE - 3, s.PIECE + 3), ("dinuc", 2, 0, 12)):
        whole = {(r.seq_id, r.pos, r.sample): r.mut_seq for r in s.shuffle_variants(df, start, end, 6, 2, mode, 5).collect()}
        near = {(r.seq_id, r.pos, r.sample): (r.wild, r.mutant) for r in s.window_shuffles(df, 6, 2, mode, 5, reach, start, end).collect()}
        cut = lambda t, p: t[max(0, p - 3 - reach) : p + 4 + reach]  # noqa: E731, B023
        assert whole and near == {(i, p, k): (cut(texts[i], p), cut(m, p)) for (i, p, k), m in whole.items()}


def test_feature_shards_give_back_matrices(spark, tmp_path):
    tracks = spark.createDataFrame([(t, g, [float(10 * g + t + 0.1 * b) for b in range(3)]) for t in range(4) for g in range(10)], "track_idx int, gene_idx long, bins array<float>")
    labels = spark.createDataFrame([(g, k, float(g - k)) for g in range(10) for k in range(2)], "gene_idx long, target_idx int, y_true double")
    parts = spark.createDataFrame([(g, "test" if g > 7 else "train") for g in range(10)], "gene_idx long, split string")
    writers.write_feature_shards(tracks, labels, parts, f"file://{tmp_path}/a", size=3)
    rows = {r.gene_idx: r for r in readers.scan_feature_shards(spark, f"file://{tmp_path}/a").collect()}
    assert sorted(rows) == list(range(10)) and {r.gene_idx for r in readers.scan_feature_shards(spark, f"file://{tmp_path}/a", "test").collect()} == {8, 9}
    for g, r in rows.items():
        assert r.targets == [g, g - 1.0] and [[round(x, 3) for x in row] for row in r.features] == [[round(10 * g + t + 0.1 * b, 3) for t in range(4)] for b in range(3)]
    assert len({(r.split, r.shard) for r in rows.values()}) == 4
    with pytest.raises(ValueError, match="different shapes"):
        writers.write_feature_shards(tracks.where("not (gene_idx = 4 and track_idx = 2)"), labels, parts, f"file://{tmp_path}/b", size=3)


def test_what_queries_write_goes_with_the_session(spark):
    from trackframe.plans import table_queries

    at = table_queries.scratch(spark, "x")
    assert spark.sparkContext.applicationId in at and at != table_queries.scratch(spark, "x")


def test_filter_features_brings_no_feature_to_one_task(spark):
    ann = spark.createDataFrame([("c", 0, 70, "+", "R"), ("c", 0, 70, "+", "R"), ("c", 0, 70, "-", "R"), ("c", 0, 200, "-", "A"), ("c", 5, 60, "-", "A")], "chrom string, start long, end long, strand string, feature string").distinct()
    settings = spark.createDataFrame([("R", "+", 60, 90), ("A", None, 0, 70)], "feature string, strand string, min_length long, max_length long")
    got = intervals.filter_features(ann, settings)
    assert sorted((r.feature, r.end) for r in got.collect()) == [("A", 60), ("R", 70)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")  # the rows are filtered before they are made distinct


def test_wide_rows_are_made_where_a_gene_is_whole(spark):
    rows = [("a", 1, 0, 2.0), ("a", 1, 1, 4.0), ("a", 2, 0, None), ("b", 9, 0, 1.0), (None, 1, 1, 5.0), (None, 1, 1, 7.0)]
    got = ensembles.pivot_predictions(spark.createDataFrame(rows, "gene_id string, target_idx int, seed int, y_pred double"), [1, 2], [0, 1])
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {"a": (3.0, 1.0, None, None, 2.0, 4.0, None, None), "b": (None,) * 8, None: (6.0, 1.0, None, None, None, 7.0, None, None)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert "of_target" not in exchanges[0] and all("max_" not in line and "max#" not in line for line in exchanges) and "REPARTITION_BY_COL" in exchanges[0]


def test_one_hot_rows_come_from_generated_code(spark):
    x = spark.createDataFrame([(1, "aN.T"), (2, None), (3, "")], "seq_id long, seq string")
    for sample in (None, 5):
        got = s.one_hot_table(x, None, 0.25, sample=sample)
        assert got.columns == ["seq_id", "pos", "base", "value"] and got.count() == 16
        assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.value for r in s.one_hot_table(x, None, 0.25).orderBy("pos", "base").collect()] == [1, 0, 0, 0, *[0.25] * 4, *[0] * 7, 1]


def test_per_base_windows_are_small_where_written(spark, tmp_path):
    """100,000 intervals of mixed starts: every base once, and a few bytes a row where four columns of plain numbers would take more."""
    bed = spark.range(0, 100_000, 1, 3).select(F.col("id").alias("row_id"), F.pmod(F.xxhash64("id"), F.lit(500_000)).alias("start")).withColumn("end", F.col("start") + F.col("row_id") % 40)
    got = intervals.per_base_windows(bed, 128).select("row_id", "mid", "interval_length", "win_start", "win_end")
    got.write.parquet(f"{tmp_path}/windows")
    size, rows = sum(f.stat().st_size for f in (tmp_path / "windows").glob("*.parquet")), spark.read.parquet(f"{tmp_path}/windows")
    assert rows.count() == sum(i % 40 for i in range(100_000)) == rows.select("row_id", "mid").distinct().count()
    assert rows.where("win_start <> mid - 64 or win_end <> mid + 64 or interval_length <> row_id % 40").count() == 0
    assert size / rows.count() < 10


def test_importance_of_whole_sequences_shuffles_letters_only(spark, sf_dir):
    """Positions are not shuffled: the only exchange lies under the windows. Rows of one seq_id still meet."""
    from trackframe.plans import queries

    plan = queries.queries()["agg31_ism_importance_whole"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    kinds = [line for line in plan.splitlines() if "Exchange" in line or "Generate" in line or "HashAggregate" in line]
    assert sum("Exchange" in line for line in kinds) == 1 and "Exchange" in kinds[-1], plan
    seqs = spark.createDataFrame([(1, "ACGTNAC"), (1, "GG"), (2, "T")], "seq_id long, seq string")
    score = lambda x: F.length(x) - F.length(F.replace(x, F.lit("G"), F.lit("")))
    took = lambda df: sorted(variants.ism_importance(variants.window_deltas(s.window_variants(df, 2), score).withColumn("fold", F.lit(0))).collect())
    assert took(variants.by_sequence(seqs)) == took(seqs) and len(took(seqs)) == 7


@pytest.mark.parametrize("name", ["str3_stream_early_stop", "str3_stream_out_of_order"])
def test_epochs_of_a_stream_are_numbered_once(spark, sf_dir, monkeypatch, name):
    from trackframe.plans import queries, views

    made, epochs = [], views.epochs
    monkeypatch.setattr(views, "epochs", lambda *a: (made.append(a), epochs(*a))[1])
    got = queries.queries()[name](spark, sf_dir)
    assert got.count() == got.select("run", "epoch").distinct().count() == epochs(spark, sf_dir).count() and len(made) == 1
