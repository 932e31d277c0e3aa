"""Faults that showed on larger tables: what grew faster than the input stays bounded."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assay.functions import hashing as H
from assay.operators import ensemble as E
from assay.operators import images as I
from assay.operators import joins as J
from assay.operators import splits as S
from assay.operators import uncertainty as U
from assay.session import small_table
from assay.sources import readers as R
from assay.streaming import jobs


def plan_text(df):
    return df._jdf.queryExecution().toString()


def test_mixer_steps_are_not_written_out(spark):
    """Each step names those before it: as columns they grew into one expression of hundreds of hashes for every weight."""
    units = spark.range(300).withColumnRenamed("id", "item")
    draws = S.poisson_draws(units, "item", 7)
    assert len(plan_text(draws.groupBy("rep").agg(F.sum(F.col("weight") * F.col("weight"))))) < 20_000
    keys = units.orderBy("item").select(*H.unit_key(F.col("item"))).toPandas().to_numpy()
    want = H.poisson_weight_array(keys[:, :1], keys[:, 1:], np.arange(7)[None, :])
    got = {(r["item"], r["rep"]): r["weight"] for r in draws.collect()}
    assert got == {(i, r): int(w) for (i, r), w in np.ndenumerate(want) if w}


def test_exact_draws_shuffle_positions_once(spark):
    units = spark.range(400).withColumnRenamed("id", "item")
    draws = S.exact_draws(units, "item", 4)
    assert len(plan_text(draws)) < 20_000
    got = {(r["rep"], r["item"]): r["weight"] for r in draws.collect()}
    keys = units.orderBy("item").select(*H.unit_key(F.col("item"))).toPandas().to_numpy()
    mixed = H.mix_array(keys[:, :1], keys[:, 1:], np.arange(4)[None, :]) % 400
    assert got == {(r, i): n for r in range(4) for i, n in enumerate(np.bincount(mixed[:, r], minlength=400).tolist()) if n}


def board_brute(parts, k, salts):
    """Boards per (run, salt): later batches replace a step's entry, what was evicted stays away."""
    boards = {}
    for part in parts:
        newest = {}
        for run, step, score, at in part:
            if score is not None:
                newest[run, step] = max(newest.get((run, step), (at, score)), (at, score))
        for (run, step), (_, score) in newest.items():
            boards.setdefault((run, step % salts), {})[step] = score
        boards = {key: dict(sorted(b.items(), key=lambda e: (-e[1], e[0]))[:k]) for key, b in boards.items()}
    out = []
    for run in sorted({r for r, _ in boards}):
        whole = sorted(((-v, s) for (r, _), b in boards.items() if r == run for s, v in b.items()))[:k]
        out += [(run, s, -v, i + 1) for i, (v, s) in enumerate(whole)]
    return sorted(out)


def test_boards_of_many_runs_share_a_call(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    monkeypatch.setattr(jobs, "BOARD_SALTS", 3)
    folder, out, parts = str(tmp_path / "log"), str(tmp_path / "out"), []
    schema = "run string, step long, v double, at long"
    for n in range(3):
        part = [(r, rng.randint(1, 12), rng.choice([None, *range(6)]), 100 * n + i) for r in range(9) for i in range(rng.randint(0, 7))]
        parts.append(part)
        small_table(spark, [(str(r), s, None if v is None else float(v), at) for r, s, v, at in part], schema).repartition(3).write.mode("append").parquet(folder)
        jobs.board_stream(jobs.read_log_stream(spark, folder, schema), out, "run", "step", "v", 2, "at")
    got = sorted((r["run"], r["step"], r["score"], r["rank"]) for r in jobs.merged_board(spark, out, 2).collect())
    assert got == board_brute(parts, 2, 3)


def test_runs_share_calls_but_not_state(spark, tmp_path, monkeypatch):
    """Hundreds of runs in a few calls; a run that is silent in a batch keeps its state, big run numbers stay whole."""
    monkeypatch.setattr(jobs, "BUCKETS", 3)
    folder, out, first = str(tmp_path / "log"), str(tmp_path / "out"), 2**60 + 1
    schema = "run long, step long, v double"
    for steps, runs in (((1, 2), range(200)), ((3,), range(0, 200, 2)), ((4,), range(200))):
        small_table(spark, [(first + r, s, float(r * s)) for r in runs for s in steps] + [(None, s, float(s)) for s in steps], schema).write.mode("append").parquet(folder)
        jobs.delta_stream(jobs.read_log_stream(spark, folder, schema), out, "run", "step", "v")
    got = {(r["run"], r["step"]): r["delta"] for r in spark.read.parquet(out).collect()}
    want = {}
    for r in range(200):
        steps = (1, 2, 3, 4) if r % 2 == 0 else (1, 2, 4)
        want |= {(first + r, s): None if i == 0 else float(r * (s - steps[i - 1])) for i, s in enumerate(steps)}
    want |= {(None, s): None if s == 1 else 1.0 for s in (1, 2, 3, 4)}
    assert got == want


def test_missing_partitions_are_scored_without_a_shuffle(spark, tmp_path):
    """Rows meet the list of missing partitions where they are: by key, a third of them would meet in one task."""
    schema = "item long, prob double, split string, member string"
    rows = small_table(spark, [(i, i / 64, "train" if i % 3 else "test", f"m{i % 2}") for i in range(60)], schema)
    path, plans = str(tmp_path / "cache"), []
    rows.where("split = 'train' and member = 'm0'").write.partitionBy("split", "member").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    given = rows.withColumn("prob", F.col("prob") + 0.0)
    full = R.fill_predictions(spark, path, given, lambda todo: (plans.append(todo._jdf.queryExecution().executedPlan().toString()), todo)[1], schema)
    assert "Exchange hashpartitioning" not in plans[0] and "BroadcastHashJoin" in plans[0]
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, rows.collect())) and stored.columns == full.columns


def test_exact_bootstrap_finds_its_units_once(spark):
    """The distinct units were found anew for every use."""
    rows = spark.range(240).selectExpr("id as item", "concat('t', id % 2) as task", "id % 3 = 0 as up", "double(id * 37 % 101) as prob").selectExpr("*", "int(up) as y")
    boot = U.bootstrap_exact(rows, ["task"], "item", 3)
    draws = S.exact_draws(rows.select("item"), "item", 3).toPandas()
    data = rows.toPandas().merge(draws, on="item")
    for r in boot.collect():
        own = data[(data["task"] == r["task"]) & (data["rep"] == r["rep"])]
        pos, neg = (own[own["y"] == v] for v in (1, 0))
        wins = np.sign(pos["prob"].to_numpy()[:, None] - neg["prob"].to_numpy()[None, :]) / 2 + 0.5
        pairs = pos["weight"].to_numpy()[:, None] * neg["weight"].to_numpy()[None, :]
        assert abs(r["auroc"] - (wins * pairs).sum() / pairs.sum()) < 1e-9
    found = []
    held = U.exact_draws
    try:
        U.exact_draws = lambda units, *a, **kw: (found.append(plan_text(units)), held(units, *a, **kw))[1]
        U.bootstrap_exact(rows, ["task"], "item", 3)
    finally:
        U.exact_draws = held
    assert "Aggregate" not in found[0]


def test_runs_with_few_targets_share_a_call(spark, monkeypatch):
    """Whole numbers stay whole beside runs without candidates; a run without a name is one run."""
    monkeypatch.setattr(J, "RUNS_PER_CALL", 50)
    big = 2**60
    targets = [(r, big + 2 * s, s) for r in range(120) for s in (1, 2, 3)] + [(None, big, 1)]
    candidates = [(r, big + c) for r in range(120) if r % 4 for c in (1, 3, 4, 5)[: r % 4 + 1]]
    t, c = small_table(spark, targets, "run long, step long, rank int"), small_table(spark, candidates, "run long, step long")
    out = J.assign_distinct(t, c, "run", "step", "rank")
    assert "pmod(xxhash64(run" in plan_text(out)
    want = set()
    for run in {r for r, _, _ in targets}:
        free = sorted(s for r, s in candidates if r == run)
        for rank, at in sorted((k, s) for r, s, k in targets if r == run):
            best = min(free, key=lambda s: (abs(s - at), s), default=None)
            free = [s for s in free if s != best]
            want.add((run, rank, at, best, None if best is None else best - at))
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)


def test_few_images_are_held_at_once(spark):
    """A batch of thousands of images is cut: what is drawn or mapped comes in pieces, and nothing is lost."""
    n = 3 * I.IMAGES_AT_ONCE + 7
    assert [len(p) for p in I.in_pieces(iter([pd.DataFrame({"a": range(n)})]))] == [I.IMAGES_AT_ONCE] * 3 + [7]
    images = spark.range(n).selectExpr("id as image_id", "2 as w", "1 as h", "unhex(lpad(hex(id), 4, '0')) as pixels").coalesce(1)
    out = I.map_pixels(images, lambda img: [{"v": int(img[0, 0]) * 256 + int(img[0, 1])}] if img[0, 1] % 2 else [], "image_id bigint, v bigint")
    assert [tuple(r) for r in out.orderBy("image_id").collect()] == [(i, i) for i in range(n) if i % 2]


def test_views_and_members_share_a_shuffle(spark):
    rows = small_table(spark, [(i, t, m, i % 2, (i + v) / 8 + len(m)) for i in range(6) for t in ("a", "b") for m in ("m", "mm") for v in range(i % 3 + 1)], "item long, task string, member string, y int, prob double")
    per = E.view_average(rows, ["item", "task", "member"], together=["item", "task"])
    out = E.flat_blend(per, ["item", "task"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = E.flat_blend(E.view_average(rows, ["item", "task", "member"]), ["item", "task"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_files_are_checked_in_few_tasks(spark):
    """400 files of a few bytes were 400 / 32 tasks and more; each task reports kilobytes to the driver."""
    n, before = 400, spark.conf.get("spark.sql.files.openCostInBytes")
    files = spark.range(n).selectExpr("id as image_id", "cast('no image' as binary) as content")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        out = I.decode_check(files, "image_id", 1.0, 7)
        reads = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Coalesce " in line]
        assert len(reads) == 2
        assert sorted(map(tuple, out.collect())) == [(i, True) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_folds_are_cut_once(spark):
    """Every job that read the folded rows placed all units anew."""
    rows = spark.range(300).selectExpr("if(id % 50 = 7, null, id % 90) as unit", "id")
    out = S.kfold(rows, "unit", 4, 42, rows_per_range=16)
    assert "Window" not in plan_text(out) and "distinct" not in plan_text(out).lower()
    found = out.collect()
    order = sorted({r["unit"] for r in found} - {None}, key=lambda u: hashlib.md5(f"42:{u}".encode()).hexdigest())
    want = {u: i * 4 // len(order) for i, u in enumerate(order)}
    assert len(found) == 300 and all(r["fold"] == want[r["unit"]] for r in found if r["unit"] is not None)


def test_search_summary_of_counted_rows(spark):
    """The search writes its counted rows; what scores its weights reads those, and gives what all rows give."""
    rows = spark.range(400).selectExpr("concat('t', id % 2) as task", "int(id * 7 % 3) as fold", "int(id * 31 % 10 < 4) as y", "double(id * 37 % 11 % 4) / 4 as a", "double(id * 53 % 7 % 3) / 3 as b")
    base = E.counted_rows(rows, ["a", "b"], "fold", "y")
    assert base.count() < 400
    found = E.grid_search(base, ["a", "b"], 3, "fold", 3, counted=True).localCheckpoint()
    assert sorted(found.collect()) == sorted(E.grid_search(rows, ["a", "b"], 3, "fold", 3).collect())
    got, want = (sorted(E.search_summary(df, found.select("task", "fold", "a", "b"), ["a", "b"], "fold", weight=w).collect()) for df, w in ((base, "_rows"), (rows, None)))
    assert [r["task"] for r in got] == ["t0", "t1"]
    np.testing.assert_allclose([r[1:] for r in got], [r[1:] for r in want], rtol=0, atol=1e-12)
