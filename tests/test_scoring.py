"""Metrics, blends, searches and intervals against direct computation, and their edge cases."""

import itertools

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions.hashing import poisson_weight_array
from assay.operators import ensemble as E
from assay.operators import metrics as M
from assay.operators import uncertainty as U
from assay.session import small_table


def auroc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    y, s = np.asarray(y), np.asarray(s)
    p, n = (w * y).sum(), (w * (1 - y)).sum()
    if p == 0 or n == 0:
        return None
    more = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
    return float(((w * y)[:, None] * (w * (1 - y))[None, :] * more).sum() / (p * n))


def average_precision(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - last) * y[hit].mean()
        last = recall
    return total


def frame(spark, y, s, **extra):
    cols = {"y": [int(v) for v in y], "prob": [None if v is None else float(v) for v in s], **extra}
    return spark.createDataFrame(list(zip(*cols.values())), list(cols))


@pytest.mark.parametrize("rows", [None, 11])
@pytest.mark.parametrize("ties", [True, False])
def test_ranking_metrics(spark, ties, rows):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) + 0.3 * y, 2 if ties else 9)
    df = frame(spark, y, s, task=["a"] * 400)
    got = M.ranking_metrics(df, ["task"], rows_per_range=rows).first()
    assert got["auroc"] == pytest.approx(auroc(y, s), abs=1e-12)
    assert got["auprc"] == pytest.approx(average_precision(y, s), abs=1e-12)
    same = M.ranking_metrics(df.withColumn("prob", F.exp(F.col("prob") * 3)), ["task"], rows_per_range=rows).first()
    assert same["auroc"] == pytest.approx(got["auroc"], abs=1e-12)


def test_one_class_ties_and_missing(spark):
    df = spark.createDataFrame(
        [("pos", 1, 0.2), ("pos", 1, 0.9), ("neg", 0, 0.2), ("neg", 0, 0.9), ("tied", 1, 0.5), ("tied", 0, 0.5),
         ("gaps", 1, float("nan")), ("gaps", 1, None), ("gaps", None, 0.4), ("gaps", 1, 0.8), ("gaps", 0, 0.1)], "task string, y int, prob double")
    got = {r["task"]: r for r in M.ranking_metrics(df, ["task"]).collect()}
    assert got["pos"]["auroc"] is None and got["pos"]["auprc"] == 1.0
    assert got["neg"]["auroc"] is None and got["neg"]["auprc"] is None
    assert got["tied"]["auroc"] == 0.5 and got["gaps"]["auroc"] == 1.0
    cuts = {r["task"]: r["threshold"] for r in M.best_f1(df, ["task"]).collect()}
    assert cuts["pos"] == 0.5 and cuts["neg"] == 0.5 and cuts["gaps"] == 0.8


def test_best_f1_takes_the_lowest_of_equals(spark):
    # F1 is 2/3 at 0.9 (p=1, r=1/2) and at 0.3 (p=1/2, r=1): the lower cut wins.
    got = M.best_f1(frame(spark, [1, 0, 0, 1], [0.9, 0.5, 0.4, 0.3]), []).first()
    assert got["threshold"] == 0.3


def test_zero_denominators_and_exclusion(spark):
    df = spark.createDataFrame([("a", 0, 0.1, False), ("a", 0, 0.2, False), ("a", 1, 0.9, True)], "task string, y int, prob double, out boolean")
    r = M.report(M.with_threshold(df, 0.5, []), ["task"], excluded="out").first()
    assert (r["precision"], r["recall"], r["f1"], r["specificity"], r["n_excluded"], r["n_pos"]) == (0.0, 0.0, 0.0, 1.0, 1, 0)
    assert r["auroc"] is None


def test_empty_input_keeps_its_shape(spark):
    df = spark.createDataFrame([], "task string, y int, prob double")
    assert M.ranking_metrics(df, ["task"]).collect() == []


def test_size_labels_round_half_to_even(spark):
    got = spark.createDataFrame([(202,), (19100,), (2500,), (3500,), (999,)], "n long").select(M.size_label(F.col("n")).alias("l"))
    assert [r["l"] for r in got.collect()] == ["val202", "val19k", "val2k", "val4k", "val999"]


def test_known_macro(spark):
    # Published per-task AUROCs of one report.
    one = small_table(spark, [("r", 0.8544), ("r", 0.9026), ("r", 0.9029), ("r", 0.9226), ("r", 0.9673)], "run string, auroc double")
    assert round(M.macro(one, ["run"], ["auroc"]).first()["mean_auroc"], 4) == 0.9100


def test_known_seed_noise(spark):
    # Published scores of three seeds of two configurations.
    rows = [("a", 0.8743), ("a", 0.8809), ("a", 0.8780), ("b", 0.8566), ("b", 0.8533), ("b", 0.8461), ("c", 0.9)]
    got = {r["config"]: r for r in U.seed_noise(small_table(spark, rows, "config string, s double"), ["config"], "s").collect()}
    assert (round(got["a"]["mean"], 4), round(got["a"]["sd"], 4)) == (0.8777, 0.0033)
    assert (round(got["b"]["mean"], 4), round(got["b"]["sd"], 4)) == (0.8520, 0.0054)
    assert got["c"]["sd"] is None
    assert {r["config"] for r in U.seed_spread(small_table(spark, rows, "config string, s double"), ["config"], "s").collect()} == {"a", "b"}


MEMBERS = ["m0", "m1", "m2"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    rows = []
    for task in ("a", "b"):
        for i in range(240):
            y = int(rng.random() < 0.4)
            rows.append((i, task, y, i % 3, *(float(v) for v in np.round(rng.normal(size=3) * np.array([1, 2, 0.7]) + y * np.array([0.4, 1.0, 0.6]), 3))))
    pdf = pd.DataFrame(rows, columns=["item_id", "task", "y", "fold", *MEMBERS])
    return small_table(spark, rows, "item_id long, task string, y int, fold int, m0 double, m1 double, m2 double"), pdf


def lattice(units):
    return [v for v in itertools.product(range(units + 1), repeat=3) if sum(v) == units]


def test_lattice(spark):
    got = E.each_lattice_vector(spark.range(1), 3, 10).collect()
    assert len(got) == E.lattice_size(3, 10) == 66 and all(r["u0"] + r["u1"] + r["u2"] == 10 for r in got)
    with pytest.raises(ValueError):
        E.each_lattice_vector(spark.range(1), 12, 40)


def test_grid_search(spark, wide):
    df, pdf = wide
    for rows in (None, 40):
        got = {(r["task"], r["fold"]): r for r in E.grid_search(df, MEMBERS, 4, "fold", 3, rows_per_range=rows).collect()}
        for task, f in itertools.product("ab", range(3)):
            d = pdf[(pdf.task == task) & (pdf.fold != f)]
            scores = {v: auroc(d.y, sum(u * d[m].to_numpy() for u, m in zip(v, MEMBERS)) / 4) for v in lattice(4)}
            top = max(scores.values())
            want = min((v for v, a in scores.items() if a >= top - 1e-9), key=lambda v: (sum((3 * u - 4) ** 2 for u in v), v))
            assert tuple(got[(task, f)][m] * 4 for m in MEMBERS) == want
            assert got[(task, f)]["auroc"] == pytest.approx(scores[want], abs=1e-12)


def test_greedy_search(spark, wide):
    df, pdf = wide
    got = {(r["task"], r["fold"]): r for r in E.greedy_search(df, MEMBERS, 4, "fold", 3, ["a", "b"]).collect()}
    grid = {(r["task"], r["fold"]): r["auroc"] for r in E.grid_search(df, MEMBERS, 4, "fold", 3).collect()}
    for (task, f), r in got.items():
        d = pdf[(pdf.task == task) & (pdf.fold != f)]
        counts = [0, 0, 0]
        for _ in range(4):
            tries = [auroc(d.y, sum((c + (i == j)) * d[m].to_numpy() for j, (c, m) in enumerate(zip(counts, MEMBERS)))) for i in range(3)]
            pick = min((counts[i], i) for i, a in enumerate(tries) if a >= max(tries) - 1e-9)[1]
            counts[pick] += 1
        assert [r[m] * 4 for m in MEMBERS] == counts
        assert r["auroc"] <= grid[(task, f)] + 1e-12


def test_weighted_blend_edges(spark):
    p = small_table(spark, [(1, "a", "m0", 1, 0.2), (1, "a", "m1", 1, 0.6), (1, "b", "m0", 0, 0.2), (1, "b", "m1", 0, 0.6)], "item_id long, task string, member string, y int, prob double")
    w = small_table(spark, [("a", "m0", 3.0), ("a", "m1", 1.0), ("b", "m0", 0.0), ("b", "m1", 0.0)], "task string, member string, w double")
    got = {r["task"]: r["prob"] for r in E.weighted_blend(p, w, ["item_id", "task"]).collect()}
    assert got["a"] == pytest.approx(0.3) and got["b"] == pytest.approx(0.4)
    with pytest.raises(Exception, match="no weight for"):
        E.weighted_blend(p, w.filter("member = 'm0'"), ["item_id", "task"]).collect()


def test_labels_and_nesting(spark):
    tree = ("prob", [("logit", ["a", "b"]), "c"])
    assert E.member_label(tree) == "avg(avg-logit(a + b) + c)"
    with pytest.raises(ValueError):
        E.check_labels(["a", "a"])
    wide = small_table(spark, [(1, "t", 0.0, 1.0, 0.5)], "item_id long, task string, a double, b double, c double")
    assert E.nested_blend(wide, tree, ["task"], "out").first()["out"] == pytest.approx(0.5)
    same = small_table(spark, [(1, "t", 0.3, 0.3)], "item_id long, task string, a double, b double")
    for space in ("prob", "logit"):
        assert E.nested_blend(same, (space, ["a", "b"]), ["task"], "out").first()["out"] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        E.to_space(wide, "odds", ["task"], "a")


def unit_numbers(unit):
    digest = hashlib.md5(str(unit).encode()).hexdigest()
    return int(digest[:7], 16), int(digest[7:14], 16)


def test_bootstrap_chunks_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(U, "FAN", 3)
    rng = np.random.default_rng(5)
    n = 600
    df = frame(spark, rng.integers(0, 2, n), np.round(rng.random(n), 2), task=["a"] * n, item=[f"patient{i}" for i in range(n)])
    one = U.bootstrap_auroc(df, ["task"], "item", 9)
    many = U.bootstrap_auroc(df, ["task"], "item", 9, chunk_rows=20)
    assert sorted((r["rep"], round(r["auroc"], 12)) for r in one.collect()) == sorted((r["rep"], round(r["auroc"], 12)) for r in many.collect())


@pytest.mark.parametrize("chunk", [32_768, 37])
def test_bootstrap_with_a_hot_score(spark, chunk):
    rng = np.random.default_rng(2)
    n, reps = 900, 70
    y = rng.integers(0, 2, n)
    s = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n) + 0.2 * y, 3))
    df = frame(spark, y, s, task=["a"] * n, item=list(range(n)))
    boot = {r["rep"]: r["auroc"] for r in U.bootstrap_auroc(df, ["task"], "item", reps, chunk_rows=chunk).collect()}
    assert len(boot) == reps
    keys = [unit_numbers(i) for i in range(n)]
    for rep in (0, 1, 63, 64, 69):
        w = poisson_weight_array(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array(rep)).astype(float)
        assert boot[rep] == pytest.approx(auroc(y, s, w), abs=1e-12)


def test_bootstrap_ignores_undefined_scores(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 0, 0.1, 2), ("a", 1, float("nan"), 3), ("a", None, 0.5, 4), ("b", 1, float("nan"), 5)], "task string, y int, prob double, item long")
    got = U.bootstrap_auroc(df, ["task"], "item", 20).collect()
    assert {r["task"] for r in got} == {"a"} and {r["auroc"] for r in got} <= {None, 1.0}


def test_exact_bootstrap_draws_n_rows(spark):
    from assay.operators.splits import exact_draws
    d = exact_draws(spark.range(500).withColumnRenamed("id", "item"), "item", 6)
    assert [r["n"] for r in d.groupBy("rep").agg(F.sum("weight").alias("n")).collect()] == [500] * 6


def test_interval_and_verdict(spark):
    boot = small_table(spark, [("a", i, float(i)) for i in range(101)] + [("a", 101, None)], "task string, rep int, auroc double")
    r = U.interval(boot, ["task"]).first()
    assert (r["low"], r["median"], r["high"], r["n_undefined"]) == (2.5, 50.0, 97.5, 1)
    v = small_table(spark, [(0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1)], "low double, high double").select(U.verdict(F.col("low"), F.col("high")).alias("v"))
    assert [x["v"] for x in v.collect()] == ["better", "worse", "within noise"]


def test_fold_auroc_leaves_undefined_scores_out(spark):
    df = spark.createDataFrame([("a", 0, 1, 0.9), ("a", 0, 0, 0.1), ("a", 0, 0, float("nan")), ("a", 0, 0, None)], "task string, fold int, y int, s double")
    got = E.fold_auroc(df, ["task"], "s", "y", "fold", 2).where("fold = 1").first()
    assert got["auroc"] == 1.0


def test_null_score_counts_as_not_predicted(spark):
    df = spark.createDataFrame([("a", 1, None, 0.5), ("a", 0, None, 0.5), ("a", 1, 0.7, 0.5)], "task string, y int, prob double, threshold double")
    r = M.confusion(df, ["task"]).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 0, 1, 1)


def test_nearly_all_scores_distinct(spark):
    """Continuous scores: the score table is as long as the input."""
    rng = np.random.default_rng(8)
    n = 4000
    y, s = rng.integers(0, 2, n), rng.random(n)
    df = frame(spark, y, s, task=["a"] * n)
    for rows in (None, 150):
        assert M.ranking_metrics(df, ["task"], rows_per_range=rows).first()["auroc"] == pytest.approx(auroc(y, s, np.ones(n)), abs=1e-12)


def test_alignment_raises_or_tells(spark):
    rows = [(1, "a", "m0", 1, 0.1), (1, "a", "m1", 1, 0.2), (2, "a", "m0", 0, 0.3)]
    df = spark.createDataFrame(rows, "item long, task string, member string, y int, prob double")
    told = {r["item"]: (r["m0"], r["m1"], r["aligned"]) for r in E.aligned(df, ["item", "task"], ["m0", "m1"], strict=False).collect()}
    assert told == {1: (0.1, 0.2, True), 2: (0.3, None, False)}
    with pytest.raises(Exception, match="not aligned at 2 / a"):
        E.aligned(df, ["item", "task"], ["m0", "m1"]).collect()
    assert E.aligned(df.where("item = 1"), ["item", "task"], ["m0", "m1"]).count() == 1


def test_staged_tables_can_be_released(spark, tmp_path):
    import os

    from assay import session

    df = session.staged(spark.range(3))
    path = session._STAGED[spark.sparkContext.applicationId][-1]
    assert df.count() == 3 and os.path.exists(path)
    kept = session._STAGED[spark.sparkContext.applicationId][:-1]
    session._STAGED[spark.sparkContext.applicationId] = [path]
    assert session.release_staged(spark) == 1 and not os.path.exists(path)
    session._STAGED[spark.sparkContext.applicationId] = kept
