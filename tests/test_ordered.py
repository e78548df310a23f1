"""Quantiles, running sums and ranks in value order against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import metrics, ordered

INF = float("inf")


@pytest.fixture(scope="module")
def rows():
    """Keys of one value, of ties, of signs and magnitudes, without values, and NULL."""
    rng = random.Random(6)
    out = {"one": [3.5], "ties": [1.0] * 500 + [2.0] * 3, "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)], "near": [1 + k * 2**-52 for k in range(300)], "small": [k * 5e-324 for k in range(-20, 20)]}
    out |= {"zero": [0.0, -0.0, 0.0, 1e-9, -1e-9], "odd": [INF, -INF, 0.0, 1.0, 2.0], "none": [None, None], None: [rng.gauss(0, 1) for _ in range(700)], "some": [None, 4.0, None, 2.0]}
    flat = [(k, v, i) for k, vs in out.items() for i, v in enumerate(vs)]
    rng.shuffle(flat)
    return out, flat


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows[1], "key string, x double, i long").repartition(5)


def test_cells_never_decrease(spark):
    rng = random.Random(1)
    xs = sorted([rng.choice([-1, 1]) * 10 ** rng.uniform(-310, 308) for _ in range(4000)] + [0.0, -INF, INF, 1.0, math.nextafter(1.0, 2), 5e-324] + [rng.random() for _ in range(4000)])
    c, f = ordered.cells(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").select("i", c.alias("c"), f.alias("f")).orderBy("i").collect()]
    assert all(a[1:] <= b[1:] for a, b in zip(got, got[1:], strict=False))
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(c, f).collect()
    assert tuple(odd[0]) == (ordered.NAN_CELL,) * 2 and tuple(odd[1]) == (ordered.NULL_CELL,) * 2


def test_quantiles_equal_numpy(rows, df):
    shares = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    got = {r[0]: r for r in ordered.exact_quantiles(df, ["key"], "x", shares).collect()}
    want = {k: [v for v in vs if v is not None] for k, vs in rows[0].items()}
    assert set(got) == {k for k, v in want.items() if v}
    for k, v in want.items():
        if v and k != "odd":
            assert got[k].n == len(v)
            assert got[k].q == pytest.approx(np.quantile(v, shares, method="linear").tolist(), rel=1e-12, abs=1e-320), k
    assert got["odd"].q[3] == 1.0 and got["odd"].q[0] == -INF and got["odd"].q[5] == INF


def test_quantiles_of_all_rows_and_of_none(spark, df):
    assert ordered.exact_quantiles(df.where("false"), [], "x", [0.5]).collect() == []
    r = ordered.exact_quantiles(spark.range(101).withColumnRenamed("id", "x"), [], "x", [0.5, 0.905]).first()
    assert (r.n, r.q) == (101, pytest.approx([50.0, 90.5]))


def test_box_stats_equal_plain_ones(rows, df):
    got = {r[0]: r for r in ordered.box_stats(df, ["key"], "x").collect()}
    for k in ("one", "ties", "near", "zero", None, "some"):
        v = np.array([x for x in rows[0][k] if x is not None])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert tuple(got[k])[1:] == pytest.approx((q1, q2, q3, v.mean(), inside.min(), inside.max()), abs=1e-12), k


def test_no_task_holds_a_key(df):
    """Nothing is put in order or collected by the key alone but counts of cells."""
    plan = ordered.exact_quantiles(df, ["key"], "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    for line in plan.splitlines():
        if "Window [" in line and "[k#" in line and "x#" in line.split("windowspec")[0]:
            raise AssertionError(line)


def test_running_sums_and_ranks(spark, rows):
    rng = random.Random(2)
    data = [(i, rng.choice("pq"), rng.choice([None, *range(-5, 40)]), rng.randint(0, 9)) for i in range(900)] + [(900 + i, "p", 7, 1) for i in range(300)]
    df = spark.createDataFrame(data, "sum_k long, part string, `order` int, n int").repartition(6)
    got = ordered.running_sum(df, ["part"], "order", "upto", F.col("n"), ("sum_k",))
    assert got.columns == [*df.columns, "upto"]
    want, total = {}, {"p": 0, "q": 0}
    for i, p, _, n in sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        total[p] += n
        want[i] = total[p]
    assert {r.sum_k: r.upto for r in got.collect()} == want
    whole = ordered.running_sum(df, [], "order", "place", ties=("sum_k",))
    assert sorted(r.place for r in whole.collect()) == list(range(1, len(data) + 1))
    assert ordered.running_sum(df.where("false"), [], "order", "place").collect() == []


def test_average_ranks(spark):
    data = [(i, "k" if i % 3 else None, [None, 1.0, 5.0, 5.0, 2.0][i * i % 5]) for i in range(200)]
    got = {r.i: r.rank_of_k for r in ordered.average_rank(spark.createDataFrame(data, "i long, key string, x double"), ["key"], "x", "rank_of_k").collect()}
    for key in ("k", None):
        own = [x for _, k, x in data if k == key and x is not None]
        for i, k, x in data:
            if k == key:
                assert got[i] == (None if x is None else sum(y < x for y in own) + (own.count(x) + 1) / 2)


def test_spearman_of_whole_targets(spark):
    rng = random.Random(4)
    rows = [("a", t := rng.random(), -t) for _ in range(50)] + [("b", rng.random(), 1.0) for _ in range(5)] + [("a", None, 3.0), ("a", 3.0, None)]
    got = {r.target: r.spearmanr for r in metrics.spearman(spark.createDataFrame(rows, "target string, y_true double, y_pred double"), ["target"]).collect()}
    assert got == {"a": pytest.approx(-1.0), "b": None}


def test_pairs_without_a_value_do_not_count(spark):
    full = [("a", float(i % 2), i % 2 * 0.5 + 0.2) for i in range(20)]
    holes = full + [("a", 1.0, None)] * 7 + [("a", None, 0.9)] * 3
    kind = "target string, y_true double, y_pred double"
    for f in (metrics.auroc, metrics.auprc):
        assert f(spark.createDataFrame(holes, kind)).first() == f(spark.createDataFrame(full, kind)).first()
