"""Ordered computations with one group holding most rows, cut into many small ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions import hashing as H
from assay.functions import ordered as O


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(3)
    n = 3000
    run = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"run": run, "at": rng.permutation(n), "v": np.round(rng.normal(size=n), 2)})
    pdf.loc[rng.random(n) < 0.1, "v"] = None
    df = spark.createDataFrame(pdf.astype({"v": object}).where(pdf.notna(), None).values.tolist(), "run long, at long, v double").repartition(7)
    return df, pdf.sort_values(["run", "at"]).reset_index(drop=True)


def collect(df):
    return df.orderBy("run", "at").toPandas().reset_index(drop=True)


@pytest.mark.parametrize("rows", [None, 13, 200])
def test_running(log, rows):
    df, pdf = log
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "seen": ("last", "v")}
    got = collect(O.running(df, ["run"], "at", aggs, rows_per_range=rows))
    g = pdf.groupby("run")["v"]
    np.testing.assert_allclose(got["s"], g.transform(lambda v: v.fillna(0).cumsum().shift(fill_value=0)), atol=1e-9)
    for name, fn in (("hi", lambda v: v.cummax().ffill().shift()), ("lo", lambda v: v.cummin().ffill().shift()), ("seen", lambda v: v.ffill().shift())):
        np.testing.assert_allclose(got[name].astype(float), g.transform(fn).astype(float), atol=1e-9)


@pytest.mark.parametrize("rows", [None, 13])
def test_index_trailing_and_neighbours(log, rows):
    df, pdf = log
    np.testing.assert_array_equal(collect(O.row_index(df, ["run"], "at", "i", rows))["i"], pdf.groupby("run").cumcount())
    got = collect(O.trailing(df, ["run"], "at", 9, {"m": F.avg("v"), "n": F.count(F.lit(1))}, rows))
    want = pdf.groupby("run")["v"].transform(lambda v: v.rolling(9, min_periods=1).mean())
    np.testing.assert_allclose(got["m"].astype(float), want, atol=1e-9)
    assert got["n"].max() == 9 and len(got) == len(pdf)
    got = collect(O.following(O.previous(df, ["run"], "at", {"p": "at"}, rows), ["run"], "at", {"f": "at"}, rows))
    g = pdf.groupby("run")["at"]
    np.testing.assert_array_equal(got["p"].fillna(-1), g.shift().fillna(-1))
    np.testing.assert_array_equal(got["f"].fillna(-1), g.shift(-1).fillna(-1))


@pytest.mark.parametrize("rows", [None, 13])
def test_average_rank(log, rows):
    df, pdf = log
    got = collect(O.ranked(df, ["run"], "v", rows, hot_rows=rows or O.HOT_ROWS))
    np.testing.assert_allclose(got["avg_rank"].astype(float), pdf.groupby("run")["v"].rank(), atol=1e-9)
    np.testing.assert_array_equal(got["group_rows"].fillna(0), pdf.groupby("run")["v"].transform("count"))


@pytest.mark.parametrize("fan", [O.FAN, 3])
def test_ranks_of_hot_values_are_met_in_many_tasks(spark, monkeypatch, fan):
    """A third of all rows share one score and a tenth have none: no task meets much more than its share of the rows."""
    rng = np.random.default_rng(8)
    n = 40_000
    draw = rng.random(n)
    a = np.where(draw < 1 / 3, 0.5, np.round(rng.random(n), 4))
    pdf = pd.DataFrame({"id": np.arange(n), "task": np.where(rng.random(n) < 0.9, "t", "u"), "a": a, "b": np.round(rng.random(n), 2)})
    pdf.loc[draw > 0.9, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    monkeypatch.setattr(O, "FAN", fan)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = O.with_ranks(df, ["task"], {"b": "rb", "a": "ra"}, hot_rows=100)
        got = out.withColumn("at", F.spark_partition_id()).toPandas().sort_values("id")
        assert list(out.columns) == [*df.columns, "rb", "ra"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for c in "ab":
        np.testing.assert_allclose(got[f"r{c}"].astype(float).to_numpy(), pdf.groupby("task")[c].rank().to_numpy())
    if fan > 3:  # rows without a score are spread over FAN salts
        assert got["at"].value_counts().max() < 1.8 * n / 16


def test_global_index(log):
    df, pdf = log
    got = O.row_index(df, [], "at", "i", 50).toPandas()
    np.testing.assert_array_equal(got["i"], got["at"])


def test_two_levels_of_cuts(log, monkeypatch):
    """Many ranges under several coarse ones give the same values."""
    monkeypatch.setattr(O, "FAN", 5)
    df, pdf = log
    got = collect(O.running(df, ["run"], "at", {"n": ("sum", "at"), "last": ("last", "v")}, rows_per_range=7))
    g = pdf.groupby("run")
    np.testing.assert_array_equal(got["n"], g["at"].cumsum() - pdf["at"])
    np.testing.assert_allclose(got["last"].astype(float), g["v"].transform(lambda v: v.ffill().shift()).astype(float), atol=1e-9)
    glob = O.row_index(df, [], "at", "i", 7).toPandas()
    np.testing.assert_array_equal(glob["i"], glob["at"])


def test_every_window_is_over_ranges(spark):
    df = spark.range(300).selectExpr("id % 3 as run", "id as at", "id * 1.0 as v")
    for out in (O.running(df, ["run"], "at", {"s": ("sum", "v")}, 13), O.row_index(df, [], "at", rows_per_range=13)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all("_range" in line for line in plan.splitlines() if "Window [" in line)


def test_places(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("a", 3, 0.9), ("a", 4, 0.5), ("b", 5, 0.1)], "k string, run int, v double")
    got = {r["run"]: r["rank"] for r in O.numbered(df, ["k"], "v", "run").collect()}
    assert got == {3: 1, 1: 2, 4: 3, 2: 4, 5: 1}


def test_mixer_agrees_between_engines_and_looks_random(spark):
    import duckdb

    ids, reps = np.arange(4000), np.arange(30)
    grid = spark.range(4000).select("id", *[c.alias(n) for c, n in zip(H.unit_key(F.col("id")), ("h", "l"))])
    keys = grid.orderBy("id").toPandas()
    w = H.poisson_weight_array(keys["h"].to_numpy()[:, None], keys["l"].to_numpy()[:, None], reps[None, :])
    each = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("rep"))
    got = H.with_mixed(each, F.col("h"), F.col("l"), F.col("rep"), "m").select("id", "rep", "m", H.poisson_weight(F.col("m")).alias("w")).toPandas().sort_values(["id", "rep"])
    np.testing.assert_array_equal(got["w"].to_numpy().reshape(4000, 30), w)
    sql = f"select m from (select id, rep, {H.mix_sql('h', 'l', 'rep', 'm')} from (select range as id, {H.unit_key_sql('range', 'h', 'l')} from range(50)), (select unnest(range(30)) as rep)) order by id, rep"
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == got["m"].tolist()[:1500]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    off = np.corrcoef(w.T)[~np.eye(30, dtype=bool)]
    assert np.abs(off).max() < 0.08
    assert len(H.poisson_cuts()) > 15


def test_units_of_any_type(spark):
    text = spark.createDataFrame([("patient50",), ("patient51",), (None,)], "u string")
    rows = text.select("u", *[c.alias(n) for c, n in zip(H.unit_key(F.col("u")), ("h", "l"))]).collect()
    assert len({(r["h"], r["l"]) for r in rows}) == 3 and all(r["h"] is not None for r in rows)
    near = spark.range(2).selectExpr("id * 2147483647 as u").select(*[c.alias(n) for c, n in zip(H.unit_key(F.col("u")), ("h", "l"))]).collect()
    assert near[0] != near[1]


def test_md5_uniform(spark):
    u = spark.range(5000).select(H.md5_uniform(1, "id").alias("u")).toPandas()["u"]
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
