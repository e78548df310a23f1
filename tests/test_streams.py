"""Streams whose input comes late, out of order, repeated or not at all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trackframe.operators import experiments, metrics
from trackframe.streaming import streams

EPOCHS = "run string, epoch int, valid_r double, valid_r2 double"
OBS = "epoch long, target string, y_true double, y_pred double"


@pytest.fixture
def files(spark, tmp_path):
    """put(rows, schema): one more file of the stream's folder."""

    def put(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)  # files are read by age

    return put


def read(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def run(stream, mode, trigger=None):
    """Rows of each batch, and the query."""
    got = []
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: got.append(list(map(tuple, df.collect()))))
    return got, writer.trigger(**(trigger or {"availableNow": True})).start()


def test_epochs_in_any_order_give_the_batch_trace(spark, tmp_path, files):
    rng = random.Random(8)
    rows = [(r, e, rng.random(), rng.random()) for r in "abc" for e in range(1, 15)]
    want = experiments.early_stopping_trace(spark.createDataFrame(rows, EPOCHS), 4, 2).select("run", "epoch", "score", "best", "unimproved", "stop")
    mixed = rng.sample(rows, len(rows))
    for at in range(0, len(mixed), 9):
        files(mixed[at : at + 9], EPOCHS)
    got, query = run(streams.stream_early_stop(read(spark, tmp_path, EPOCHS), 4, 2), "append")
    query.awaitTermination()
    got = [r for b in got for r in b]
    assert all(r[6] is False for r in got)
    assert sorted(r[:6] for r in got) == sorted(map(tuple, want.collect()))
    assert all([r[1] for r in got if r[0] == k] == list(range(1, 15)) for k in "abc")  # each run's epochs leave in order


def test_repeated_and_missing_epochs_are_told(spark, tmp_path, files):
    """Rows for an epoch that was judged or is held are late; those without epoch too; what waits for a gap stays in the state."""
    files([("a", 1, 0.5, 0.0), ("a", 3, 0.9, 0.0), ("a", 3, 0.1, 0.0)], EPOCHS)
    files([("a", 1, 0.7, 0.0), ("a", None, 0.2, 0.0), ("b", 2, 0.3, 0.0)], EPOCHS)
    files([("a", 2, 0.6, 0.4), ("b", 0, 0.1, 0.0)], EPOCHS)
    got, query = run(streams.stream_early_stop(read(spark, tmp_path, EPOCHS), 0, 0), "append")
    query.awaitTermination()
    late = sorted(((r[0], r[1], r[2]) for b in got for r in b if r[6]), key=repr)
    assert late == sorted([("a", 3, 0.1), ("a", 1, 0.7), ("a", None, 0.2), ("b", 0, 0.1)], key=repr)
    assert [r[:6] for b in got for r in b if not r[6]] == [("a", 1, 0.5, True, 0, False), ("a", 2, 0.7, True, 0, False), ("a", 3, 0.9, True, 0, False)]


def test_a_run_that_hears_nothing_goes_on(spark, tmp_path, files):
    files([("a", 1, 0.5, 0.0), ("a", 4, 0.4, 0.0), ("a", 3, 0.3, 0.0)], EPOCHS)
    got, query = run(streams.stream_early_stop(read(spark, tmp_path, EPOCHS), 2, 1, wait_ms=1000), "append", {"processingTime": "300 milliseconds"})
    try:
        end = time.time() + 60
        while sum(map(len, got)) < 3 and time.time() < end:
            time.sleep(0.2)
        files([("a", 2, 9.0, 0.0)], EPOCHS)
        while sum(map(len, got)) < 4 and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [r for b in got for r in b] == [("a", 1, 0.5, True, 0, False, False), ("a", 3, 0.3, False, 2, True, False), ("a", 4, 0.4, False, 3, True, False), ("a", 2, 9.0, None, None, None, True)]


def test_old_epochs_leave_the_state(spark, tmp_path, files):
    """Twelve epochs of ten targets: sums of keep + 1 epochs stay; the last value of each epoch is the batch metric; a row of an epoch that has left is dropped and counted."""
    rng = random.Random(3)
    rows = [(e, f"t{t}", rng.random(), rng.random()) for e in range(1, 13) for t in range(10) for _ in range(4)]
    for e in range(1, 13):
        files([r for r in rows if r[0] == e], OBS)
    files([(2, "t0", 1.0, 1.0), (None, "t0", 1.0, 1.0)], OBS)
    got, query = run(streams.stream_metrics_by_epoch(read(spark, tmp_path, OBS), ["target"], keep=1), "update")
    query.awaitTermination()
    last = {r[:2]: r[2:] for b in got for r in b}
    want = {tuple(r)[:2]: tuple(r)[2:] for r in metrics.by_target(spark.createDataFrame(rows, OBS), ["epoch", "target"]).collect()}
    assert last.keys() == want.keys()
    for k, (n, pearson, r2) in want.items():
        assert last[k] == (n, pytest.approx(pearson), pytest.approx(r2))
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in state) <= 30 and state[-1]["numRowsTotal"] <= 20
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1


def test_closed_epochs_are_appended_once(spark, tmp_path, files):
    for e in (1, 2, 1, 3, 4):
        files([(e, "t", float(k), float(k * e)) for k in range(5)], OBS)
    got, query = run(streams.stream_metrics_by_epoch(read(spark, tmp_path, OBS), ["target"], keep=1), "append")
    query.awaitTermination()
    closed = [(r[0], r[2]) for b in got for r in b]
    assert closed[:1] == [(1, 10)] and len({e for e, _ in closed}) == len(closed) and 4 not in dict(closed)


def test_files_of_a_stream_are_bounded(spark, sf_dir, monkeypatch):
    from trackframe.plans import table_queries

    monkeypatch.setattr(table_queries, "FILE_ROWS", 1000)
    at, files = table_queries._folder(spark, sf_dir, "lineitem")
    rows = spark.read.parquet(at).groupBy("_metadata.file_path").count().collect()
    assert files == len(rows) == 6 + (sum(r["count"] for r in rows) > 6000) and max(r["count"] for r in rows) <= 1000
