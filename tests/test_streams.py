"""State machines over restarts and replays, growing files, phases, counters."""

import os
import random

import pytest

from assay.operators import windows as W
from assay.session import small_table
from assay.sources.growing import GrowingReader, Piece
from assay.streaming import jobs
from assay.streaming.processors import Rolling

LOG = "run string, step long, v double"


def feed(spark, folder, rows, schema=LOG):
    small_table(spark, rows, schema).write.mode("append").parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_run_of_the_first_batch_keeps_its_state(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    for i in range(4):
        feed(spark, folder, [("r", i + 1, float(i % 3))] + ([("old", 1, 0.5)] if i == 0 else []))
        jobs.track_best(jobs.read_log_stream(spark, folder, LOG), out, "run", "step", "v", patience=9)
    got = {r["run"]: (r["best"], r["best_step"], r["last_step"]) for r in jobs.latest_state(spark, out).collect()}
    assert got == {"r": (2.0, 3, 4), "old": (0.5, 1, 1)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The last batch is run again, as after a crash between its rows and its commit; then the stream goes on."""
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    start = lambda: jobs.rolling_stream(jobs.read_log_stream(spark, folder, LOG), out, "run", "step", ["v"], 3)
    for part in ([1, 2], [3, 4]):
        feed(spark, folder, [("r", s, float(s)) for s in part])
        start()
    commits = f"{out}-checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    feed(spark, folder, [("r", 5, 5.0)])
    start()
    assert rows(spark.read.parquet(out)) == [("r", 1, 1.0), ("r", 2, 3.0), ("r", 3, 6.0), ("r", 4, 9.0), ("r", 5, 12.0)]


def test_rows_seen_before_are_skipped(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in ([(1, 5.0), (2, None), (2, None)], [(2, 7.0), (3, 6.0), (4, 8.0)]):
        feed(spark, folder, [("r", s, v) for s, v in part])
        jobs.delta_stream(jobs.read_log_stream(spark, folder, LOG), out, "run", "step", "v")
    assert rows(spark.read.parquet(out)) == [("r", 1, None), ("r", 2, None), ("r", 3, 1.0), ("r", 4, 2.0)]


def test_state_of_silent_runs_expires(spark, tmp_path):
    """With a time to live of a millisecond every batch begins anew."""
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    for s in (1, 2):
        feed(spark, folder, [("r", s, float(s))])
        jobs.delta_stream(jobs.read_log_stream(spark, folder, LOG), out, "run", "step", "v", ttl_ms=1)
    assert rows(spark.read.parquet(out)) == [("r", 1, None), ("r", 2, None)]


PHASES = "run string, step long, v double, phase int, a double, b double"


def phased_brute(log, patience, stops_from, sign):
    out = []
    for run in sorted({r[0] for r in log}):
        best = best_step = stop = phase = None
        idle, kept, last = 0, {}, {"a": None, "b": None}
        for _, step, v, p, a, b in sorted(r for r in log if r[0] == run):
            if phase is not None and p > phase:
                idle = 0
            phase = p
            last = {n: step if x is not None else last[n] for n, x in (("a", a), ("b", b))}
            if v is not None and (best is None or sign * v > sign * best):
                best, best_step, idle, kept = v, step, 0, {"a": a, "b": b, "at": dict(last)}
            else:
                idle += 1
            if p >= stops_from and idle >= patience:
                stop = step
                break
        at = kept.get("at", {"a": None, "b": None})
        out.append((run, best, best_step, stop, kept.get("a"), at["a"], kept.get("b"), at["b"]))
    return out


def phased_log(seed, runs=6, steps=30):
    rng = random.Random(seed)
    some = lambda share: rng.randint(0, 9) / 4 if rng.random() < share else None
    cut = {r: rng.choice([0, 7, 12, 99]) for r in range(runs)}
    return [(f"r{r}", s, some(0.8), 0 if s <= cut[r] else 1 if s <= cut[r] + 9 else 2, some(0.5), some(0.3)) for r in range(runs) for s in range(1, steps + 1)]


@pytest.mark.parametrize("mode, stops_from", [("max", 1), ("min", 2)])
def test_phases_in_batch_and_stream(spark, tmp_path, mode, stops_from):
    log = phased_log(3 + stops_from)
    want = phased_brute(log, 5, stops_from, 1 if mode == "max" else -1)
    columns = ["run", "best", "best_step", "stop_step", "a", "a_last_step", "b", "b_last_step"]
    df = small_table(spark, log, PHASES)
    for kw in ({}, {"rows_per_range": 3}):
        got = W.phased_tracker(df, ["run"], "step", "v", 5, "phase", stops_from, ["a", "b"], mode, **kw)
        assert rows(got.select(*columns)) == want
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    for low, high in ((1, 11), (12, 13), (14, 30)):
        feed(spark, folder, [r for r in log if low <= r[1] <= high], PHASES)
        jobs.track_best(jobs.read_log_stream(spark, folder, PHASES), out, "run", "step", "v", 5, mode, "phase", stops_from, ["a", "b"])
    assert rows(jobs.latest_state(spark, out, ["a", "b"]).select(*columns)) == want


def test_counters_that_start_again(spark, tmp_path):
    readings = [3, 5, 5, 9, 2, 4, 1, 1]
    gains = [3, 2, 0, 4, 2, 2, 1, 0]
    df = small_table(spark, [("r", i + 1, float(c)) for i, c in enumerate(readings)], LOG)
    for kw in ({}, {"rows_per_range": 2}):
        assert [r["v"] for r in W.counter_gains(df, ["run"], "step", ["v"], **kw).orderBy("step").collect()] == gains
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    for low, high in ((1, 4), (5, 8)):
        df.where(f"step between {low} and {high}").write.mode("append").parquet(folder)
        jobs.counter_stream(jobs.read_log_stream(spark, folder, LOG), out, "run", "step", ["v"])
    assert [r["v"] for r in spark.read.parquet(out).orderBy("step").collect()] == gains


def test_rolling_sums_of_nulls():
    import pandas as pd

    new = pd.DataFrame({"step": [3, 4, 5], "v": [None, None, 2.0]})
    out, state = Rolling(["v"], 2).work(new, (2, [1.0]))
    assert out["sum_v"].tolist()[0::2] == [1.0, 2.0] and pd.isna(out["sum_v"][1]) and state == ([2.0],)


def test_growing_files(spark, tmp_path):
    """Appended to between triggers, cut in the middle of a line, a file that comes later, other column orders, quotes and empty fields."""
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    (folder / "deep").mkdir(parents=True)
    schema = "run string, step long, v double"
    start = lambda: jobs.run_to_end(jobs.read_growing_log(spark, str(folder), schema, 16), out)
    lines = [f"r,{i},{i / 4}\n" for i in range(40)]
    log, other = folder / "a.csv", folder / "deep" / "b.csv"
    with open(log, "a") as f:
        f.write("run,step,v\n" + "".join(lines[:10]) + lines[10][:3])
        f.flush()
        start()
        assert spark.read.parquet(out).count() == 10
        f.write(lines[10][3:] + "".join(lines[11:25]))
        f.flush()
        other.write_text('step,more,run\n1,x,"a, ""b"""\n,y,')
        (folder / "c.csv").write_text("run,st")
        (folder / "notes.txt").write_text("run,step,v\nno,1,1\n")
        start()
        f.write("".join(lines[25:]))
    with open(other, "a") as f:
        f.write("\n")
    start()
    start()
    want = [("r", i, i / 4) for i in range(40)] + [('a, "b"', 1, None), (None, None, None)]
    assert rows(spark.read.schema(schema).parquet(out)) == sorted(want, key=repr)


def test_a_file_that_became_shorter_ends_the_stream(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("step\n1\n2\n")
    jobs.run_to_end(jobs.read_growing_log(spark, str(folder), "step long"), out)
    (folder / "a.csv").write_text("step\n1\n")
    (folder / "b.csv").write_text("step\n1\n")
    with pytest.raises(Exception, match="shorter"):
        jobs.run_to_end(jobs.read_growing_log(spark, str(folder), "step long"), out)


def test_every_cut_of_a_file_gives_its_lines_once(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    path = tmp_path / "a.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(120)))
    size = path.stat().st_size
    for split in (1, 2, 3, 7, 50, 1000):
        reader = GrowingReader(StructType([StructField("n", LongType())]), {"path": str(tmp_path), "splitBytes": str(split)})
        pieces = reader.partitions({"files": "{}"}, reader.latestOffset())
        assert all(isinstance(p, Piece) for p in pieces) and pieces[-1].high == size
        assert [v for p in pieces for b in reader.read(p) for v in b.column(0).to_pylist()] == list(range(120))
