"""Labels, splits, joins, runs, sources, images and streams on small hand-made tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import images as I
from assay.operators import joins as J
from assay.operators import labels as L
from assay.operators import profile as P
from assay.operators import runs as R
from assay.operators import splits as S
from assay.operators import windows as W
from assay.plans.images_q import encode_png
from assay.session import small_table
from assay.sources import readers, sinks
from assay.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# ---- labels ----

def test_policies(spark):
    cells = small_table(spark, [(1,), (0,), (-1,), (None,)], "raw int")
    want = {"ones": [1, 0, 1, 0], "zeros": [1, 0, 0, 0], "multiclass": [1, 0, 2, 0], "mask": [1, 0, None, 0], "selftrained": [1, 0, None, 0]}
    for policy, expected in want.items():
        assert [r[0] for r in cells.select(L.encode(F.col("raw"), F.lit(policy))).collect()] == expected
    with pytest.raises(Exception, match="unknown label policy"):
        cells.select(L.encode(F.col("raw"), F.lit("maybe"))).collect()


def test_layout(spark):
    got = rows(L.task_layout(spark, ["a", "b", "c"], "ones", {"b": "multiclass"}), "pos")
    assert got == [(0, "a", "ones", 1, 0), (1, "b", "multiclass", 3, 1), (2, "c", "ones", 1, 4)]
    for bad in (("mixed", {"a": "ones"}), ("ones", {"zz": "ones"}), ("sometimes", {})):
        with pytest.raises(ValueError):
            L.task_layout(spark, ["a", "b"], *bad)


def test_soft_fill_keeps_first_and_defaults_to_positive(spark):
    cells = small_table(spark, [("p", 1), ("q", None), ("r", None), ("s", None)], "path string, y int")
    soft = small_table(spark, [("q", 0.2, 5), ("q", 0.9, 7), ("s", None, 1)], "path string, prob double, o int")
    got = rows(L.soft_fill(cells, soft, ["path"], "y", "o").select("path", "y", "filled", "no_soft"))
    assert got == [("p", 1.0, False, False), ("q", 0.2, True, False), ("r", 1.0, True, True), ("s", 1.0, True, True)]


def test_binarize(spark):
    cells = small_table(spark, [("multiclass", 2), ("multiclass", 1), ("multiclass", None), ("mask", None), ("mask", 0)], "policy string, e int")
    y, out = L.binarize(F.col("e"), F.col("policy"), exclude_uncertain=True)
    assert [tuple(r) for r in cells.select(y, out).collect()] == [(1, True), (1, False), (1, True), (1, True), (0, False)]
    y, out = L.binarize(F.col("e"), F.col("policy"))
    assert not any(r[0] for r in cells.select(out).collect())


def test_paths(spark):
    df = small_table(spark, [("d/patient00012/study3/view1_frontal.jpg",), ("x/view2_LATERAL.png",), ("none",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(L.patient_key(p), L.study_key(p), L.derive_view(p), L.remap_prefix(p, "d/", "e/f/")).collect()]
    assert got == [("patient00012", "patient00012/study3", "Frontal", "e/f/patient00012/study3/view1_frontal.jpg"), (None, None, "Lateral", "x/view2_LATERAL.png"), (None, None, "Unknown", "none")]


# ---- splits ----

@pytest.mark.parametrize("ranges", [None, 16])
def test_group_holdout(spark, ranges):
    df = spark.range(6000).selectExpr("id", "case when id % 3 = 0 then 0 else id % 501 end as g")
    cut = S.group_holdout(df, "g", 0.1, 42, rows_per_range=ranges)
    n = df.select("g").distinct().count()
    assert cut.filter("held_out").select("g").distinct().count() == math.ceil(n * 0.1)
    shared = S.leakage(cut.withColumn("s", F.when(F.col("held_out"), "val").otherwise("train")), "g", "s", ["train", "val"]).first()
    assert shared["shared"] == 0
    again = S.group_holdout(df.repartition(13), "g", 0.1, 42, rows_per_range=ranges)
    assert rows(again.filter("held_out").select("id")) == rows(cut.filter("held_out").select("id"))


@pytest.mark.parametrize("ranges", [None, 50])
def test_folds_and_samples(spark, ranges):
    df = spark.range(1003)
    sizes = [r["count"] for r in S.kfold(df, "id", 5, 1, rows_per_range=ranges).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1
    assert S.simple_sample(df, "id", 77, 3).count() == 77 == S.group_sample(df, "id", 77, 3, rows_per_range=ranges).count()
    assert rows(S.simple_sample(df, "id", 77, 3)) == rows(S.group_sample(df, "id", 77, 3, rows_per_range=ranges))
    order = S.epoch_order(df, "id", 1, 2, skip=3, rows_per_range=ranges).toPandas()
    assert sorted(order["position"]) == list(range(3, 1003))
    assert S.simple_sample(df, "id", 5000, 3).count() == 1003


@pytest.mark.parametrize("n", [0, 1, 2, 9_999, 10_001, 20_004])
def test_sample_size_is_exact(spark, n):
    """Units twice, and a null unit many times."""
    df = spark.range(10_000).union(spark.range(10_000)).union(spark.range(4).selectExpr("cast(null as bigint)"))
    got = S.simple_sample(df, "id", n, 3)
    assert got.count() == n and rows(got) == rows(S.simple_sample(df.repartition(5), "id", n, 3))


def test_targets_without_candidates_are_kept(spark):
    t = small_table(spark, [("r", 1, 1), ("r", 2, 2), ("r", 3, 3), ("q", 5, 1)], "run string, step long, rank int")
    c = small_table(spark, [("r", 2), ("r", 9)], "run string, step long")
    got = {(r["run"], r["rank"]): r["chosen"] for r in J.assign_distinct(t, c, "run", "step", "rank").collect()}
    assert got == {("r", 1): 2, ("r", 2): 9, ("r", 3): None, ("q", 1): None}


# ---- joins ----

def test_nearest_prefers_the_earlier_step(spark):
    t = small_table(spark, [("r", 500, 1), ("r", 90, 2), ("r", 700, 3), ("s", 5, 4)], "run string, at long, id long")
    c = small_table(spark, [("r", 400), ("r", 600), ("r", 600)], "run string, at long")
    got = {int(r["id"]): (r["chosen"], r["gap"]) for r in J.nearest(t, c, ["run"], "at", "id").collect()}
    assert got == {1: (400.0, -100.0), 2: (400.0, 310.0), 3: (600.0, -100.0), 4: (None, None)}
    assert {int(r["id"]): r["chosen"] for r in J.nearest(t, c, ["run"], "at", "id", prefer="later").collect()}[1] == 600.0


def test_distinct_assignment(spark):
    rng = np.random.default_rng(4)
    t = [("r", int(s), k + 1) for k, s in enumerate(rng.choice(300, 6, replace=False))]
    c = sorted({int(x) for x in rng.choice(300, 40)})
    free, want = list(c), []
    for _, step, rank in t:
        best = min(free, key=lambda x: (abs(x - step), x))
        free.remove(best)
        want.append((rank, best))
    got = J.assign_distinct(small_table(spark, t, "run string, step long, rank int"), small_table(spark, [("r", x) for x in c], "run string, step long"), "run", "step", "rank")
    assert [(r["rank"], r["chosen"]) for r in got.orderBy("rank").collect()] == want


def test_fallback_and_collisions(spark):
    a = small_table(spark, [("x", 1.0), ("y", None)], "k string, v double")
    b = small_table(spark, [("x", 2.0), ("y", 3.0), ("z", 4.0)], "k string, v double")
    assert rows(J.fallback([("a", a), ("b", b)], "k", "v")) == [("x", 1.0, "a", False), ("y", 3.0, "b", True), ("z", 4.0, "b", True)]
    audit = rows(J.collision_audit([("a", a.select("k")), ("b", b.select("k"))], "k"))
    assert audit == [("a", 2, 2, 0), ("b", 3, 1, 2)]


# ---- profiles ----

@pytest.mark.parametrize("ranges", [None, 20])
def test_percentiles_and_distribution(spark, ranges):
    rng = np.random.default_rng(9)
    v = np.round(rng.gamma(2, 1, 500), 2)
    df = spark.createDataFrame([("g", float(x)) for x in v], "k string, v double")
    r = P.distribution(df, ["k"], "v", rows_per_range=ranges).first()
    s = pd.Series(v)
    assert r["skew"] == pytest.approx(s.skew()) and r["std"] == pytest.approx(s.std())
    for p in (1, 5, 25, 50, 75, 95, 99):
        assert r[f"p{p}"] == pytest.approx(np.percentile(v, p))
    e = P.ecdf(df, ["k"], "v", rows_per_range=ranges).orderBy("v").toPandas()
    np.testing.assert_allclose(e["ecdf"], [(v <= x).mean() for x in e["v"]])


def test_histogram_closes_the_last_bin(spark):
    df = small_table(spark, [(0.0,), (0.5,), (1.0,), (2.0,)], "v double")
    assert [r["n"] for r in P.histogram(df, "v", 0.0, 1.0, 4).orderBy("bin").collect()] == [1, 0, 1, 1]


# ---- runs and windows ----

def test_best_tracker_and_stop(spark):
    scores = [0.5, 0.5, None, 0.6, 0.6, 0.1, 0.2, 0.7]
    df = small_table(spark, [("r", i + 1, s) for i, s in enumerate(scores)], "run string, step long, v double")
    for kw in ({}, {"rows_per_range": 2}):
        got = rows(W.best_so_far(df, ["run"], "step", "v", **kw).select("step", "improved", "best", "no_improve"), "step")
        assert [g[1] for g in got] == [True, False, False, True, False, False, False, True]
        assert [g[3] for g in got] == [0, 1, 2, 0, 1, 2, 3, 0]
    assert W.early_stop(df, ["run"], "step", "v", 3).first()[1:] == (0.6, 4, 7)
    low = W.early_stop(df, ["run"], "step", "v", 3, mode="min").first()
    assert (low["best"], low["best_step"], low["stop_step"]) == (0.5, 1, 4)


def test_cadence_must_fit():
    with pytest.raises(ValueError):
        W.cadence(F.lit(3), 7, 5)


def test_settings_merge(spark):
    base = small_table(spark, [("a.x", "1"), ("a.y", "2"), ("b.z", "3"), ("c", "4"), ("d.e.f", "5"), ("g", "6")], "path string, value string")
    over = small_table(spark, [("a.x", "9"), ("b", None), ("c.q", "7"), ("d", "off"), ("g", None), ("n", None)], "path string, value string")
    assert rows(R.merge_settings(base, over), "path") == [("a.x", "9"), ("a.y", "2"), ("b.z", "3"), ("c.q", "7"), ("d", "off"), ("g", None), ("n", None)]


def test_aliases(spark):
    df = small_table(spark, [("valid200",), ("test500",), ("val19k",)], "s string")
    got = [r[0] for r in df.select(R.resolve_alias(F.col("s"), ["val200", "test500", "val19k"])).collect()]
    assert got == ["val200", "test500", "val19k"]
    for bad in ("val500", "200", "other"):
        with pytest.raises(Exception, match="unknown split"):
            small_table(spark, [(bad,)], "s string").select(R.resolve_alias(F.col("s"), ["val200", "test500"])).collect()


# ---- sources ----

def test_weights_of_another_space_or_with_gaps_raise(spark, tmp_path):
    (tmp_path / "run=a").mkdir()
    (tmp_path / "run=a" / "w.json").write_text('{"combine_space": "logit", "members": ["m", "n"], "weights_per_class": {"t": {"m": 1.0}}}')
    with pytest.raises(Exception, match="another space"):
        readers.read_weights(spark, str(tmp_path), ["t"], space="prob").collect()
    with pytest.raises(Exception, match="no weight for n on t"):
        readers.read_weights(spark, str(tmp_path), ["t"]).collect()


def test_bad_rows_and_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,y\n")
    assert rows(readers.read_label_table(spark, str(tmp_path / "t.csv"), "a int, b string"), "b") == [(1, "x"), (None, "y")]
    (tmp_path / "bad.csv").write_text("a,b\noops,x\n")
    with pytest.raises(Exception):
        readers.read_label_table(spark, str(tmp_path / "bad.csv"), "a int, b string").collect()
    with pytest.raises(ValueError):
        readers.read_metric_log(spark, str(tmp_path), "run long, step long", "mean_auroc")
    assert readers.read_optional(spark, str(tmp_path / "absent"), "a int").count() == 0


def test_versions_are_never_overwritten(spark, tmp_path):
    one = small_table(spark, [(1,)], "v int")
    sinks.write_version(one, str(tmp_path / "v"), "2024")
    with pytest.raises(Exception):
        sinks.write_version(one, str(tmp_path / "v"), "2024")
    nan = small_table(spark, [(float("nan"),), (float("inf"),), (1.0,)], "v double").select(sinks.finite(F.col("v")))
    assert [r[0] for r in nan.collect()] == [None, None, 1.0]


def test_scan_reads_only_what_is_needed(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity > 49").groupBy("l_returnflag").agg(F.count(F.lit(1)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


# ---- images ----

def test_headers_and_decoding(spark, tmp_path):
    img = (np.arange(20 * 30).reshape(20, 30) % 256).astype(np.uint8)
    whole = encode_png(img)
    assert I.header(whole) == (30, 20, "L") and I.png_is_whole(whole)
    assert I.header(b"nothing") is None and not I.png_is_whole(whole[:60]) and not I.png_is_whole(whole[:-20] + b"x" * 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x14\x00\x1e\x03" + b"\0" * 9
    assert I.header(jpeg) == (30, 20, "RGB")
    assert I.is_whole(jpeg + b"\xff\xd9") and not I.is_whole(jpeg) and I.is_whole(whole) and not I.is_whole(whole[:60])
    (tmp_path / "a.png").write_bytes(whole)
    (tmp_path / "b.png").write_bytes(b"broken")
    got = {r["origin"].rsplit("/", 1)[1]: r for r in I.decode_folder(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["ok"]) == (30, 20, True) and not got["b.png"]["ok"]
    assert bytes(got["a.png"]["data"]) == img.tobytes()
    assert readers.list_files(spark, str(tmp_path)).count() == 2


def test_decode_check_decodes(spark):
    """A JPEG with a readable header, an end marker and a damaged middle is corrupt, and so is a cut one."""
    java = spark._jvm.java
    img, out = java.awt.image.BufferedImage(64, 64, 10), java.io.ByteArrayOutputStream()
    for x in range(64):
        for y in range(64):
            img.getRaster().setSample(x, y, 0, x * y * 7 % 256)
    spark._jvm.javax.imageio.ImageIO.write(img, "jpg", out)
    jpeg = bytes(out.toByteArray())
    half = len(jpeg) // 2
    png = encode_png(np.zeros((20, 30), np.uint8))
    cases = [("jpeg", jpeg), ("middle", jpeg[:half] + b"\xff" * 200 + jpeg[half + 200:]), ("cut", jpeg[:half]), ("png", png), ("png", png), ("png cut", png[:60]), ("none", None), ("", b"text")]
    assert I.is_whole(cases[1][1])
    files = spark.createDataFrame([(k, c) for k, c in cases], "name string, content binary")
    got = sorted((r["name"], r["corrupt"]) for r in I.decode_check(files, "name", 1.1, 7).collect())
    assert got == sorted((k, k not in ("jpeg", "png")) for k, _ in cases)
    assert I.decode_check(files.where("false"), "name", 1.1, 7).count() == 0


# ---- streams ----

def test_tracker_goes_on_after_restart_and_ignores_rows_after_the_stop(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    parts = [[("r", 1, 0.5), ("r", 2, 0.4)], [("r", 3, 0.3), ("q", 1, 0.1)], [("r", 4, 0.9), ("q", 2, 0.2)]]
    for part in parts:
        small_table(spark, part, "run string, step long, v double").write.mode("append").parquet(folder)
        jobs.track_best(jobs.read_log_stream(spark, folder, "run string, step long, v double"), out, "run", "step", "v", patience=2)
    got = {r["run"]: r for r in jobs.latest_state(spark, out).collect()}
    assert (got["r"]["best"], got["r"]["best_step"], got["r"]["stop_step"]) == (0.5, 1, 3)
    assert (got["q"]["best"], got["q"]["best_step"], got["q"]["stop_step"]) == (0.2, 2, None)


def test_late_rows_are_dropped(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (["2024-01-01 00:05:00", "2024-01-01 03:00:00"], ["2024-01-01 00:06:00", "2024-01-01 05:00:00"]):
        spark.createDataFrame([(t, "k", 1.0) for t in part], "t string, k string, v double").selectExpr("cast(t as timestamp) as ts", "k", "v").write.mode("append").parquet(folder)
        stream = jobs.read_log_stream(spark, folder, "ts timestamp, k string, v double")
        jobs.run_to_end(jobs.windowed(stream, "ts", "k", "v", "1 hour"), out)
    got = rows(spark.read.parquet(out).selectExpr("hour(start)", "n"))
    assert got == [(0, 1), (3, 1)]


def test_a_step_logged_twice_in_one_batch(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    small_table(spark, [("1", 5, 0.9, 1), ("1", 5, 0.2, 2), ("1", 6, 0.5, 3)], "run string, step long, v double, at long").repartition(3).write.parquet(folder)
    jobs.board_stream(jobs.read_log_stream(spark, folder, "run string, step long, v double, at long"), out, "run", "step", "v", 2, "at")
    assert [(r["step"], r["score"]) for r in jobs.merged_board(spark, out, 2).orderBy("rank").collect()] == [(6, 0.5), (5, 0.2)]
