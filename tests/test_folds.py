"""Folds over groups, draws down a tree, two-sided running values, the pruned searches, merged profiles."""

import math
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions.ordered import two_sided
from assay.operators import ensemble as E
from assay.operators import joins as J
from assay.operators import labels as L
from assay.operators import profile as P
from assay.operators import splits as S
from assay.session import fresh_path


@pytest.mark.parametrize("per_range", [None, 3, 40])
def test_two_sided_is_the_plain_statement(spark, per_range):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, None if rng.random() < 0.2 else int(rng.integers(-50, 50))) for i in range(400)] + [(None, 1000, 5), (None, 1001, 7)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    out = two_sided(df, ["k"], "o", {"low": ("max", "v"), "s": ("sum", "v"), "l": ("last", "v")}, {"high": ("min", "v"), "t": ("sum", "v")}, rows_per_range=per_range)
    seen = 0
    for r in out.collect():
        earlier = [v for k, o, v in rows if k == r["k"] and o < r["o"] and v is not None]
        later = [v for k, o, v in rows if k == r["k"] and o > r["o"] and v is not None]
        assert (r["low"], r["s"], r["l"]) == (max(earlier, default=None), sum(earlier), earlier[-1] if earlier else None)
        assert (r["high"], r["t"]) == (min(later, default=None), sum(later))
        seen += 1
    assert seen == 402
    with pytest.raises(ValueError):
        two_sided(df, ["k"], "o", {}, {"x": ("last", "v")})


@pytest.mark.parametrize("prefer", ["earlier", "later"])
def test_nearest_against_all_pairs(spark, prefer):
    rng = np.random.default_rng(4)
    targets = pd.DataFrame({"run": ["a"] * 60 + ["b"] * 5 + ["c"], "at": rng.integers(0, 80, 66), "id": [str(i) for i in range(66)]})
    cand = pd.DataFrame({"run": ["a"] * 30 + ["b"], "at": np.append(rng.integers(0, 80, 30), 7)})
    got = J.nearest(spark.createDataFrame(targets), spark.createDataFrame(cand), ["run"], "at", "id", prefer, rows_per_range=5).collect()
    assert len(got) == 66
    for r in got:
        own = sorted(set(cand[cand["run"] == r["run"]]["at"]))
        best = min(own, key=lambda c: (abs(c - r["at"]), c if prefer == "earlier" else -c), default=None)
        assert r["chosen"] == best and r["gap"] == (None if best is None else best - r["at"])


def _auroc(score, y):
    ok = ~np.isnan(score)
    pos, neg = score[ok & (y == 1)], score[ok & (y == 0)]
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg)))


def _members(seed, n=240):
    """Continuous scores of three members, one of them no better than chance, with repeated and undefined ones."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    df = pd.DataFrame({"task": np.where(np.arange(n) % 3 == 0, "s", "t"), "fold": rng.integers(0, 3, n), "y": y, **{f"m{i}": 0.3 * i * y + rng.normal(size=n) for i in range(3)}})
    df.loc[0, "m1"] = np.nan
    df.loc[[1, 2], ["m0", "m1", "m2"]] = 0.25
    return pd.concat([df, df.iloc[:20], pd.DataFrame({"task": ["one"] * 4, "fold": [0, 1, 2, 0], "y": [1] * 4, **{f"m{i}": [0.1, 0.2, 0.3, 0.4] for i in range(3)}})], ignore_index=True)


def _best(df, vectors, total, tie):
    """(task, fold) -> auroc and weights of the best vector, ties by ``tie``."""
    out = {}
    for (t, f) in product(sorted(set(df["task"])), range(3)):
        part = df[(df["task"] == t) & (df["fold"] != f)]
        scored = {v: _auroc(sum(u * part[f"m{i}"].to_numpy() for i, u in enumerate(v)) / total, part["y"].to_numpy()) for v in vectors(t, f)}
        scored = {v: a for v, a in scored.items() if a is not None}
        if scored:
            top = max(scored.values())
            out[(t, f)] = (top, min((v for v, a in scored.items() if a >= top - E.TIE), key=tie))
    return out


def test_grid_search_prunes_and_gives_the_same(spark):
    df = _members(5)
    lattice = [v for v in product(range(5), repeat=3) if sum(v) == 4]
    want = _best(df, lambda t, f: lattice, 4, lambda v: (sum((3 * u - 4) ** 2 for u in v), v))
    got = E.grid_search(spark.createDataFrame(df), ["m0", "m1", "m2"], 4, "fold", 3, rows_per_range=16).collect()
    assert {(r["task"], r["fold"]) for r in got} == set(want)
    for r in got:
        auroc, v = want[(r["task"], r["fold"])]
        assert r["auroc"] == pytest.approx(auroc, abs=1e-12) and tuple(r[f"m{i}"] * 4 for i in range(3)) == v


def test_bounds_hold_and_leave_few(spark):
    df = spark.createDataFrame(_members(6, 900))
    base = E.counted_rows(df, ["m0", "m1", "m2"], "fold", "y")
    each = E.each_lattice_vector(base, 3, 4).withColumn("_score", E.lattice_blend(["m0", "m1", "m2"], 4))
    keys = ["task", "u0", "u1", "u2"]
    bounds = E.fold_bounds(each, keys, "_score", "y", "fold", 3, E.score_span(base, ["m0", "m1", "m2"]), "_rows")
    both = bounds.join(E.fold_auroc(each, keys, "_score", "y", "fold", 3, "_rows"), [*keys, "fold"]).filter("auroc is not null").toPandas()
    assert (both["least"] <= both["auroc"] + 1e-12).all() and (both["auroc"] <= both["most"] + 1e-12).all()
    assert (both["most"] - both["least"]).max() < 0.02
    reach = both.groupby(["task", "fold"])["least"].transform("max")
    assert (both["most"] >= reach).sum() < len(both) / 2


@pytest.mark.parametrize("odd", [math.inf, -math.inf])
def test_bounds_with_infinite_scores(spark, odd):
    df = spark.createDataFrame([("t", i % 3, i % 2, odd if i == 4 else 0.5, 1) for i in range(30)], "task string, fold int, y int, s double, n int")
    bounds = {r["fold"]: r for r in E.fold_bounds(df, ["task"], "s", "y", "fold", 3, E.score_span(df, ["s"]), "n").collect()}
    for r in E.fold_auroc(df, ["task"], "s", "y", "fold", 3, "n").collect():
        assert bounds[r["fold"]]["least"] <= r["auroc"] <= bounds[r["fold"]]["most"]


def test_greedy_search_against_all_candidates(spark):
    df, rounds = _members(7), 3
    got = {(r["task"], r["fold"]): r for r in E.greedy_search(spark.createDataFrame(df), ["m0", "m1", "m2"], rounds, "fold", 3, ["s", "t", "one"]).collect()}
    counts, last = {k: (0, 0, 0) for k in got}, dict.fromkeys(got)
    for _ in range(rounds):
        plus = lambda c, i: c[:i] + (c[i] + 1,) + c[i + 1:]
        for k, (top, v) in _best(df, lambda t, f: [plus(counts[(t, f)], i) for i in range(3)], 1, lambda v: 0).items():
            part = df[(df["task"] == k[0]) & (df["fold"] != k[1])]
            scores = [_auroc(sum(u * part[f"m{j}"].to_numpy() for j, u in enumerate(plus(counts[k], i))), part["y"].to_numpy()) for i in range(3)]
            pick = min((counts[k][i], i) for i, a in enumerate(scores) if a >= top - E.TIE)[1]
            counts[k], last[k] = plus(counts[k], pick), top
    assert len(got) == 9
    for k, r in got.items():
        assert (r["auroc"] is None) == (last[k] is None)
        if last[k] is not None:
            assert r["auroc"] == pytest.approx(last[k], abs=1e-12) and tuple(round(r[f"m{i}"] * rounds) for i in range(3)) == counts[k]
        else:
            assert r["m0"] == pytest.approx(1 / 3)


def _labelled(n=6000, groups=900):
    rng = np.random.default_rng(8)
    g = np.where(rng.random(n) < 0.05, 0, rng.integers(1, groups, n))
    leaning = rng.random(groups)[g]
    labels = {f"t{i}": (rng.random(n) < share * (0.5 + leaning)).astype(int) for i, share in enumerate((0.4, 0.1, 0.01))}
    return pd.DataFrame({"row": np.arange(n), "g": g, **labels})


@pytest.mark.parametrize("per_bucket", [4096, 200])
def test_group_folds_keep_groups_and_shares(spark, per_bucket):
    df = _labelled()
    out = S.balanced_group_folds(spark.createDataFrame(df), "g", ["t0", "t1", "t2"], 5, 42, groups_per_bucket=per_bucket).toPandas()
    assert len(out) == len(df) and set(out["fold"]) == set(range(5))
    assert (out.groupby("g")["fold"].nunique() == 1).all()
    per = out.groupby("fold")[["t0", "t1", "t2"]].sum()
    assert per["t2"].max() - per["t2"].min() <= 3
    assert ((per - per.mean()).abs() <= 0.1 * per.mean() + 2).all().all()
    again = S.balanced_group_folds(spark.createDataFrame(df).repartition(7, "row"), "g", ["t0", "t1", "t2"], 5, 42, groups_per_bucket=per_bucket).toPandas()
    assert out.sort_values("row")["fold"].tolist() == again.sort_values("row")["fold"].tolist()


def test_group_folds_odd_tables(spark):
    schema = "g string, t int, fold_key string, _c0 int"
    none = S.balanced_group_folds(spark.createDataFrame([], schema), "g", ["t"], 3, 1)
    assert none.count() == 0 and none.columns == ["g", "t", "fold_key", "_c0", "fold"]
    rows = [(None, 1, "x", 0), (None, 0, "x", 0), ("", None, "x", 0), ("a", None, "x", 0), ("a", -1, "x", 0)]
    out = S.balanced_group_folds(spark.createDataFrame(rows, schema), "g", ["t"], 3, 1).collect()
    assert len(out) == 5 and len({r["fold"] for r in out if r["g"] is None}) == 1
    assert len({(r["g"], r["fold"]) for r in out}) == 3


@pytest.mark.parametrize("leaf", [4096, 7])
def test_tree_draws_are_multinomial(spark, leaf):
    n, reps = 50, 4000
    units = spark.range(n).withColumnRenamed("id", "u")
    out = S.tree_draws(units, "u", reps, units_per_leaf=leaf, rows_per_range=10).collect()
    counts = np.array([r["draws"] for r in sorted(out, key=lambda r: r["u"])])
    assert counts.shape == (n, reps) and (counts.sum(axis=0) == n).all()
    assert np.abs(counts.mean(axis=1) - 1).max() < 5 * math.sqrt(1 / reps)
    variance = 1 - 1 / n
    assert np.abs(counts.var(axis=1) - variance).max() < 0.15
    cov = np.cov(counts)
    off = cov[~np.eye(n, dtype=bool)]
    assert off.mean() == pytest.approx(-1 / n, abs=2e-3) and np.abs(off + 1 / n).max() < 5.5 / math.sqrt(reps)
    again = S.tree_draws(units.repartition(5), "u", reps, units_per_leaf=leaf, rows_per_range=10).collect()
    assert sorted(out) == sorted(again)


def test_each_draw_and_no_units(spark):
    units = spark.range(9).withColumnRenamed("id", "u")
    draws = S.each_draw(S.tree_draws(units, "u", 3, units_per_leaf=2), "u")
    assert draws.columns == ["rep", "u", "weight"] and draws.filter("weight <= 0").count() == 0
    assert [r["n"] for r in draws.groupBy("rep").agg(F.sum("weight").alias("n")).collect()] == [9, 9, 9]
    assert S.tree_draws(units.limit(0), "u", 3).count() == 0


def test_profile_of_increments_is_the_full_one(spark):
    rng = np.random.default_rng(9)
    rows = [(int(s), f"k{rng.integers(2)}", None if rng.random() < 0.1 else int(rng.integers(100)), None if rng.random() < 0.1 else f"m{rng.integers(3)}", bool(rng.random() < 0.2)) for s in rng.integers(0, 4, 300)]
    df = spark.createDataFrame(rows, "shard int, k string, size bigint, mode string, bad boolean")
    state = lambda part: P.profile_state(part, "shard", ["k"], "size", "mode", F.col("bad"))
    path = fresh_path(spark, "profile")
    P.store_profile(state(df.where("shard < 2").withColumn("size", F.col("size") + 1)), path, "shard")
    P.store_profile(state(df.where("shard = 2")), path, "shard")
    P.store_profile(state(df.where("shard in (0, 1, 3)")), path, "shard")
    stored = spark.read.schema(state(df).schema).parquet(path)
    assert sorted(P.merged_profile(stored, ["k"]).collect()) == sorted(P.merged_profile(state(df), ["k"]).collect())
    for r in P.merged_profile(stored, ["k"]).collect():
        own = [x for x in rows if x[1] == r["k"]]
        modes = pd.Series([x[3] for x in own if x[3]]).value_counts()
        assert r["n"] == len(own) and r["total_size"] == sum(x[2] or 0 for x in own) and r["n_bad"] == sum(x[4] for x in own)
        assert r["n_modes"] == len(modes) and r["top_mode"] == max((n, m) for m, n in modes.items())[1]


def test_layout_from_cells(spark):
    cells = spark.createDataFrame([("b", 1), ("b", -1), ("a", None), ("c", 0), (None, 1)], "task string, raw int")
    got = sorted(L.layout_of(cells, "ones", {"b": "multiclass"}).collect(), key=lambda r: r["pos"])
    assert [(r["task"], r["policy"], r["start"], r["n_labelled"], r["n_unsure"]) for r in got] == [("a", "ones", 0, 0, 0), ("b", "multiclass", 1, 2, 1), ("c", "ones", 4, 1, 0)]
    for default, overrides in (("mixed", {"a": "ones", "b": "ones"}), ("ones", {"z": "ones"})):
        with pytest.raises(ValueError):
            L.layout_of(cells, default, overrides)
    assert L.layout_of(cells.limit(0), "ones").count() == 0
