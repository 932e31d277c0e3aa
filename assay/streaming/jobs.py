"""Metric logs as streams: ingest, trackers, boards, rolling values, event-time windows.

Step-ordered trackers are state machines, one per run and BUCKETS calls at most a batch, whose small state Spark keeps in
its state store and checkpoint (processors.py). They add their rows to a folder exactly once: a batch that is run again after a
failure starts from the state that it started from before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assay.operators.windows import top_n
from assay.sources import growing
from assay.streaming.processors import BestTracker, Counters, Deltas, Rolling


def read_log_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Follow a folder to which whole log files are added."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(folder)


def read_growing_log(spark: SparkSession, folder: str, schema: str, split_bytes: int = growing.SPLIT) -> DataFrame:
    """Follow the CSV files of a folder as they grow, and new ones as they come."""
    growing.register(spark)
    return spark.readStream.format(growing.FORMAT).schema(schema).option("splitBytes", split_bytes).load(folder)


def run_to_end(stream: DataFrame, out: str, fmt: str = "parquet", once: bool = False) -> None:
    """Append everything that has arrived to ``out``; a later call goes on from there.

    ``once`` takes it in one batch: streams whose state has a time to live would go on to check it for ever.
    """
    trigger = {"once": True} if once else {"availableNow": True}
    query = stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(**trigger).start()
    query.awaitTermination()


def _each_batch(stream: DataFrame, out: str, fn: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


#: State that grows with the runs lives on the executors' disks and in the checkpoint, not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Groups into which runs are dealt by hash: what a batch costs beside its rows does not grow with the runs.
BUCKETS = 1_024


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def keyed(stream: DataFrame, run: str, step: str, columns: dict[str, str | Column], processor: StatefulProcessor, output: str, ttl: bool = False) -> DataFrame:
    """Rows of each run in a state machine of its own; columns maps the processor's names to those of the stream, output names what follows the run."""
    kind = stream.schema[run].dataType
    bucket = F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int").alias("_bucket")
    rows = stream.select(bucket, F.col(run).cast("string").alias("run"), F.col(step).cast("bigint").alias("step"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    out = rows.groupBy("_bucket").transformWithStateInPandas(processor, f"run string, {output}", "Append", "ProcessingTime" if ttl else "None")
    return out.withColumn("run", F.col("run").cast(kind))


def run_keyed(rows: DataFrame, out: str, once: bool) -> None:
    """Append what the state machines give to ``out``, exactly once, until all that has arrived is read."""
    with _state_on_disk(rows.sparkSession):
        run_to_end(rows, out, once=once)


def track_best(
    stream: DataFrame, out: str, run: str, step: str, value: str, patience: int, mode: str = "max",
    phase: str | None = None, stops_from: int = 0, sets: list[str] | None = None, ttl_ms: int | None = None,
) -> None:
    """Best value so far, its step, and the step at which patience ran out, per run; with phases and sets as in the batch tracker."""
    sets = sets or []
    number = {f"set{i}": F.col(c).cast("double") for i, c in enumerate(sets)}
    columns = {"value": F.col(value).cast("double"), "phase": F.col(phase).cast("bigint") if phase else F.lit(0).cast("bigint"), **number}
    tracker = BestTracker(patience, 1 if mode == "max" else -1, stops_from, list(number), ttl_ms)
    output = "last_step bigint, best double, best_step bigint, idle bigint, stop_step bigint, at_best array<double>, seen_at_best array<bigint>"
    run_keyed(keyed(stream, run, step, columns, tracker, output, ttl_ms is not None), out, ttl_ms is not None)


def latest_state(spark: SparkSession, out: str, sets: list[str] | None = None) -> DataFrame:
    """The tracker's last word on every run."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("run").agg(F.max_by(F.struct("best", "best_step", "stop_step", "at_best", "seen_at_best"), "last_step").alias("_s"), F.max("last_step").alias("last_step"))
    scored = [c for i, n in enumerate(sets or []) for c in (F.get("_s.at_best", F.lit(i)).alias(n), F.get("_s.seen_at_best", F.lit(i)).alias(f"{n}_last_step"))]
    return last.select("run", "_s.best", "_s.best_step", "_s.stop_step", "last_step", *scored)


def rolling_stream(stream: DataFrame, out: str, run: str, step: str, columns: list[str], width: int, ttl_ms: int | None = None) -> None:
    """(run, step, sum_<column>): sums over the last ``width`` steps of each run."""
    output = "step bigint, " + ", ".join(f"sum_{c} double" for c in columns)
    run_keyed(keyed(stream, run, step, {c: F.col(c).cast("double") for c in columns}, Rolling(columns, width, ttl_ms), output, ttl_ms is not None), out, ttl_ms is not None)


def delta_stream(stream: DataFrame, out: str, run: str, step: str, value: str, ttl_ms: int | None = None) -> None:
    """(run, step, delta): difference to the run's last defined value."""
    run_keyed(keyed(stream, run, step, {"value": F.col(value).cast("double")}, Deltas(ttl_ms), "step bigint, delta double", ttl_ms is not None), out, ttl_ms is not None)


def counter_stream(stream: DataFrame, out: str, run: str, step: str, counters: list[str], ttl_ms: int | None = None) -> None:
    """(run, step, counters): what each cumulative counter gained since the run's row before, across restarts from zero."""
    output = "step bigint, " + ", ".join(f"{c} double" for c in counters)
    run_keyed(keyed(stream, run, step, {c: F.col(c).cast("double") for c in counters}, Counters(counters, ttl_ms), output, ttl_ms is not None), out, ttl_ms is not None)


def _put(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


BOARD_SALTS = 16


def board_stream(stream: DataFrame, out: str, run: str, step: str, value: str, k: int, order: str | None = None) -> None:
    """Top-k board per run as keyed state of at most k entries.

    A run is spread over salts of its step, so a run with a third of all rows is not one state
    machine; a step logged again meets its own entry and replaces it. Boards of (run, salt) are dealt into buckets by hash, and a
    bucket's new rows of a batch are folded into its boards together: a call of their own for boards of a few rows
    would outweigh the rows. ``order`` is a numeric place in the log: of a
    step logged twice in one batch the later value stands. Without it the higher value does.
    """
    later = F.col(order).cast("double") if order else F.col(value).cast("double")
    salt = F.pmod(F.col(step), F.lit(BOARD_SALTS)).cast("int")
    keyed = stream.select(
        F.pmod(F.xxhash64(run, salt), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.col(run).cast("bigint").cast("string").alias("run"), F.coalesce(salt, F.lit(0)).alias("salt"), F.col(step).cast("bigint").alias("step"),
        F.col(value).cast("double").alias("score"), later.alias("at"),
    )
    entry, kinds = ["run", "salt", "step"], {"run": object, "salt": "int64", "step": "int64", "score": float}

    def fold(key, frames, state: GroupState):
        held = pd.DataFrame(dict(zip(kinds, state.get)) if state.exists else {c: [] for c in kinds}).astype(kinds)
        newest, touched = [], []
        for pdf in frames:
            touched.append(pdf[["run", "salt"]].drop_duplicates())
            newest.append(pdf[[*kinds, "at"]].dropna(subset=["step", "score"]))
            if len(newest) > 1:  # one row per step so far, and the next frame
                newest = [_latest(pd.concat(newest), entry)]
        newest, touched = _latest(newest[0], entry).drop(columns="at").astype(kinds), pd.concat(touched).drop_duplicates()
        both = pd.concat([held, newest]).drop_duplicates(entry, keep="last")
        board = both.sort_values(["score", "step"], ascending=[False, True]).groupby(["run", "salt"], dropna=False, sort=False).head(k)
        state.update(tuple([None if v != v else v for v in board[c].tolist()] for c in kinds))
        yield board.merge(touched, on=["run", "salt"])

    boards = keyed.groupBy("bucket").applyInPandasWithState(
        fold, "run string, salt int, step bigint, score double", "runs array<string>, salts array<int>, steps array<bigint>, scores array<double>", "update", GroupStateTimeout.NoTimeout
    ).withColumn("run", F.col("run").cast("bigint"))

    def batch(df: DataFrame, batch_id: int) -> None:
        _put(df, f"{out}/rows/batch={batch_id}")

    with _state_on_disk(stream.sparkSession):
        _each_batch(boards, out, batch, "update")


def _latest(rows: pd.DataFrame, entry: list[str]) -> pd.DataFrame:
    """Of each entry the row with the latest place, of one place the highest score."""
    return rows.sort_values(["at", "score"], na_position="first").drop_duplicates(entry, keep="last")


def merged_board(spark: SparkSession, out: str, k: int) -> DataFrame:
    """Current board: the last emission of every salt, merged."""
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("run", "salt").agg(F.max("batch").alias("batch"))
    return top_n(rows.join(last, ["run", "salt", "batch"]).select("run", "step", "score"), ["run"], "score", "step", k).drop("delta")


def windowed(stream: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window; rows later than ``delay`` are dropped."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    agg = stream.withWatermark(ts, delay).groupBy(win.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    agg = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
