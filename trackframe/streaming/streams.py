"""Structured Streaming: running metrics, scoring, early stopping, epoch logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators.ensembles import score_batches
from trackframe.operators.experiments import parse_epoch_lines
from trackframe.operators.metrics import moment_sums, pearson_of_sums, r2_of_sums
from trackframe.sources.readers import file_name


def stream_metrics(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson and R squared so far, from six running sums a key; output mode update or complete. With an
    epoch among the keys, every epoch starts anew."""
    return obs.groupBy(*keys).agg(*moment_sums()).select(*keys, "n", pearson_of_sums().alias("pearsonr"), r2_of_sums().alias("r2"))


def stream_metrics_by_epoch(obs: DataFrame, keys: list[str], epoch: str = "epoch", keep: int = 1) -> DataFrame:
    """epoch, keys, n, pearsonr, r2 so far of obs(epoch, keys, y_true, y_pred); output mode update, or append for closed epochs only.

    Every epoch starts anew. The epoch is the stream's event time: once a batch has brought epoch e, the sums of all epochs before
    e - keep leave the state, so that it holds keep + 1 epochs however long the stream runs. Rows of epochs that have left are
    dropped; the query's progress counts them (numRowsDroppedByWatermark). Rows without an epoch are left out.
    """
    at = F.timestamp_seconds(F.col(epoch).cast("long"))
    timed = obs.where(F.col(epoch).isNotNull()).select(at.alias("at_"), *keys, "y_true", "y_pred").withWatermark("at_", f"{keep} seconds")
    sums = timed.groupBy("at_", *keys).agg(*moment_sums())
    return sums.select(F.unix_seconds("at_").alias(epoch), *keys, "n", pearson_of_sums().alias("pearsonr"), r2_of_sums().alias("r2"))


def stream_scoring(examples: DataFrame, models: dict[str, Callable], key: str, features: str) -> DataFrame:
    """Scores appended as examples arrive."""
    return score_batches(examples, models, key, features)


def stream_early_stop(epochs: DataFrame, min_epochs: int, patience: int, first: int = 1, wait_ms: int | None = None) -> DataFrame:
    """(run, epoch, score, best, unimproved, stop, late) as epochs(run, epoch, valid_r, valid_r2) arrive in any order; append mode.

    A run's epochs are judged one by one from `first` on. One that comes early is held in the run's state until those before it are
    there, so the trace is that of all epochs in order, whatever the order of files and batches. The state is the best
    score, that epoch, the epoch that is next, and what is held: nothing, where epochs come in order.

    With `wait_ms`, a run that has heard nothing for so many milliseconds stops waiting for what is missing and goes on
    with what it holds. What comes for an epoch that has been judged, or is held already, is given out as `late`, with its score and nothing
    else; so each row of the input gives a row. Rows without epoch are late ones too.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, frames: Iterator, state: GroupState):
        import pandas as pd

        best, best_epoch, due, *held = state.get if state.exists else (float("-inf"), first - 1, first, [], [])
        held, out = dict(zip(*map(list, held), strict=True)), []

        def judge(epoch: int):
            nonlocal best, best_epoch, due
            score = held.pop(epoch)
            better = bool(score > best)
            if better:
                best, best_epoch = score, epoch
            due = epoch + 1
            out.append((key[0], epoch, score, better, epoch - best_epoch, epoch >= min_epochs and epoch - best_epoch > patience, False))

        if state.hasTimedOut:
            for epoch in sorted(held):
                judge(epoch)
        else:
            for rows in frames:
                for epoch, r, r2 in zip(rows["epoch"], rows["valid_r"], rows["valid_r2"], strict=True):
                    score = float(r + r2 / 4)
                    if pd.isna(epoch) or epoch < due or epoch in held:
                        out.append((key[0], None if pd.isna(epoch) else int(epoch), score, None, None, None, True))
                    else:
                        held[int(epoch)] = score
            while due in held:
                judge(due)
        state.update((float(best), int(best_epoch), int(due), list(held), list(held.values())))
        if wait_ms is not None and held:
            state.setTimeoutDuration(wait_ms)
        if out:
            kinds = {"epoch": "Int32", "best": "boolean", "unimproved": "Int32", "stop": "boolean"}
            columns = zip(["run", "epoch", "score", "best", "unimproved", "stop", "late"], map(list, zip(*out, strict=True)), strict=True)
            # Made with their kinds: to convert a frame of every run takes several times longer than to judge its epochs.
            yield pd.DataFrame({c: pd.array(x, kinds[c]) if c in kinds else x for c, x in columns})

    kind = epochs.schema["run"].dataType.simpleString()
    held = "best double, best_epoch int, due int, held array<int>, scores array<double>"
    return epochs.groupBy("run").applyInPandasWithState(step, f"run {kind}, epoch int, score double, best boolean, unimproved int, stop boolean, late boolean", held, "append", timeout)


def stream_epoch_logs(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Epoch rows of log files as they appear in a folder, at most `files` of them a micro-batch."""
    return parse_epoch_lines(spark.readStream.option("maxFilesPerTrigger", files).text(path).select("value", F.regexp_replace(file_name(), r"\.log$", "").alias("run")))
