"""Bootstrap intervals, paired differences, seed noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.hashing import poisson_weight_array, unit_key
from assay.functions.ordered import FAN, before_ranges, place, running, settled
from assay.operators.metrics import ranking_metrics
from assay.operators.splits import exact_draws

CHUNK_ROWS = 32_768
BLOCK_CELLS = 1 << 18  # rows x replicates held at once: a few megabytes stay in the processor's cache


def _chunked(df: DataFrame, keys: list[str], score: str, unit: str, rows: int) -> tuple[DataFrame, bool]:
    """Give every row a chunk of at most about ``rows`` rows with neighbouring scores; and tell whether chunks have two levels.

    A score held by more than ``rows`` rows is a chunk of its own, spread over salts: rows that
    share one score need no common order. Only the cut scores travel, the rows are not joined
    with their histogram.
    """
    counts = settled(df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n")), "scores")
    placed = running(counts, keys, score, {"_below": ("sum", "_n"), "_last": ("last", "_n")}, stored=True)
    heavy, after = F.col("_n") > rows, F.coalesce(F.col("_last") > rows, F.lit(False))
    block, last = F.floor(F.col("_below") / rows), F.floor((F.col("_below") - F.col("_last")) / rows)
    # a chunk begins where the count passes a multiple of rows, at a heavy score and right after one
    begins = placed.filter((block != last) | heavy | after).select(
        *keys, F.col(score).alias("_cut"), (F.pmod(block, F.lit(FAN)) == 0).alias("_coarse"), F.when(heavy, F.ceil(F.col("_n") / rows)).cast("long").alias("_extra")
    )
    spread, deep = place(df, settled(begins, "chunks"), keys, score, "_chunk", "_salts")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(unit), F.col("_salts"))).otherwise(F.lit(0))
    return spread.withColumn("_salt", salt).withColumn("_hot", F.col("_salts").isNotNull()).drop("_salts"), deep


def bootstrap_auroc(df: DataFrame, keys: list[str], unit: str, reps: int, score: str = "prob", y: str = "y", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """AUROC of every group in every replicate, with Poisson(1) weights per unit.

    A unit is any value; NULL is one unit. Its weight is a function of its key and the replicate, so all members and tasks see the
    same draws and no draw is ever shuffled: the rows are shuffled once, by chunk of neighbouring
    scores, whatever the number of replicates. Each chunk returns, per replicate, its positives,
    negatives and ordered pairs; chunks are then combined like one score table.
    """
    high, low = unit_key(F.col(unit))
    slim = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*keys, high.alias("_uh"), low.alias("_ul"), F.col(score).cast("double").alias("_s"), F.col(y).cast("double").alias("_y"))
    slim = settled(slim.filter(~F.isnan("_s")), "cells")
    chunked, deep = _chunked(slim, keys, "_s", "_ul", chunk_rows)
    group = [*keys, "_chunk", "_salt", "_hot"]
    kinds = dict(chunked.dtypes)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["_s"]).sort_values("_s", kind="stable")
        if pdf.empty:
            return pd.DataFrame(columns=[*group, "rep", "_p", "_n", "_pairs"])
        s, truth, highs, lows = (pdf[c].to_numpy() for c in ("_s", "_y", "_uh", "_ul"))
        first = np.r_[True, s[1:] != s[:-1]]
        # a row is a positive, a negative, or by a share of its label both
        pos, neg = np.flatnonzero(truth != 0), np.flatnonzero(truth != 1)
        own, rest = (None if np.isin(truth, (0, 1)).all() else x[:, None] for x in (truth[pos], 1 - truth[neg]))
        # negatives before the rows that share a positive's score, and before those after them
        place = np.cumsum(first) - 1
        starts = np.append(np.flatnonzero(first), len(s))
        low, high = (np.searchsorted(neg, starts[place[pos] + k]) for k in (0, 1))
        parts = []
        block = max(1, BLOCK_CELLS // len(pdf))
        for lo in range(0, reps, block):
            rep = np.arange(lo, min(lo + block, reps))
            w = poisson_weight_array(highs[:, None], lows[:, None], rep[None, :])
            up, down = (w[pos], w[neg]) if own is None else (w[pos] * own, w[neg] * rest)
            below = np.zeros((len(neg) + 1, len(rep)), np.int64 if own is None else float)
            np.cumsum(down, axis=0, out=below[1:])
            pairs = (up * (below[low] + below[high])).sum(axis=0) / 2
            parts.append(pd.DataFrame({"rep": rep, "_p": up.sum(axis=0, dtype=float), "_n": below[-1].astype(float), "_pairs": pairs}))
        out = pd.concat(parts, ignore_index=True)
        for k in group:
            out[k] = pdf[k].iloc[0]
        return out[[*group, "rep", "_p", "_n", "_pairs"]]

    schema = ", ".join(f"{k} {kinds[k]}" for k in group) + ", rep int, _p double, _n double, _pairs double"
    # A number given here is kept: few bytes, much work, so partitions must not be merged by size.
    spread = chunked.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    parts = spread.groupBy(*group).applyInPandas(weigh, schema)
    merged = parts.groupBy(*keys, "rep", "_chunk", "_hot").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_pairs").alias("_pairs"))
    merged = settled(merged.withColumn("_pairs", F.when(F.col("_hot"), F.col("_p") * F.col("_n") / 2).otherwise(F.col("_pairs"))), "replicates")
    below = before_ranges(merged.select(*keys, "rep", "_chunk", "_n"), [*keys, "rep"], "_chunk", {"_below": ("sum", "_n")}, deep)
    p, n = F.sum("_p"), F.sum("_n")
    return merged.join(below, [*keys, "rep", "_chunk"]).groupBy(*keys, "rep").agg(
        F.when((p > 0) & (n > 0), F.sum(F.col("_pairs") + F.col("_p") * F.coalesce("_below", F.lit(0.0))) / (p * n)).alias("auroc")
    )


def bootstrap_exact(df: DataFrame, keys: list[str], unit: str, reps: int, score: str = "prob", y: str = "y") -> DataFrame:
    """The same with N draws of N units per replicate; for up to about a million units."""
    draws = exact_draws(settled(df.select(unit).distinct(), "units"), unit, reps)
    return ranking_metrics(df.join(draws, unit), [*keys, "rep"], score, y, weight="weight").select(*keys, "rep", "auroc")


def macro_by_rep(boot: DataFrame, keys: list[str]) -> DataFrame:
    return boot.groupBy(*keys, "rep").agg(F.avg("auroc").alias("auroc"))


def interval(boot: DataFrame, keys: list[str], value: str = "auroc", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval, median, sd and undefined replicates. A group has one row per replicate."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    return boot.groupBy(*keys).agg(
        q[0].alias("low"), q[2].alias("high"), q[1].alias("median"), F.stddev_samp(value).alias("sd"), F.count_if(F.col(value).isNull()).alias("n_undefined")
    )


def result_block(df: DataFrame, unit: str, reps: int, score: str = "prob", y: str = "y", **kw) -> DataFrame:
    """Per task and for their mean ('mean'): number of units, point AUROC and its bootstrap interval."""
    boot = settled(bootstrap_auroc(df, ["task"], unit, reps, score, y, **kw), "boot")
    spread = interval(boot, ["task"]).unionByName(interval(macro_by_rep(boot, []), []).withColumn("task", F.lit("mean")))
    points = settled(ranking_metrics(df, ["task"], score, y).select("task", F.col("auroc").alias("point")), "points")
    points = points.unionByName(points.agg(F.avg("point").alias("point")).withColumn("task", F.lit("mean")))
    sizes = df.groupBy("task", unit).agg(F.lit(1).alias("_one")).groupBy("task").agg(F.count(F.lit(1)).alias("n_units"))
    sizes = sizes.unionByName(df.select(unit).distinct().agg(F.count(F.lit(1)).alias("n_units")).withColumn("task", F.lit("mean")))
    return points.join(spread, "task").join(sizes, "task").select("task", "n_units", "point", "low", "high", "sd")


def paired_difference(boot: DataFrame, member: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """a - b on the same draws; undefined where either is."""
    def side(name, col):
        return F.max(F.when(F.col(member) == name, F.col("auroc"))).alias(col)

    per = boot.filter(F.col(member).isin(a, b)).groupBy(*keys, "rep").agg(side(a, "_a"), side(b, "_b"))
    return per.withColumn("diff", F.col("_a") - F.col("_b"))


def paired_summary(diffs: DataFrame, keys: list[str]) -> DataFrame:
    better = F.avg((F.col("diff") > 0).cast("int")).alias("p_better")
    q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
    out = diffs.groupBy(*keys).agg(F.avg("diff").alias("mean_diff"), q[0].alias("low"), q[1].alias("high"), better)
    return out.withColumn("verdict", verdict(F.col("low"), F.col("high")))


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("within noise")


def seed_noise(df: DataFrame, config: list[str], score: str) -> DataFrame:
    """Mean and sd over the seeds of a configuration and split; sd is NULL for a single seed."""
    return df.groupBy(*config).agg(F.count(score).alias("n_seeds"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"))


def seed_spread(df: DataFrame, config: list[str], score: str) -> DataFrame:
    """max - min per configuration and split that has at least two seeds."""
    return df.groupBy(*config).agg(F.count(score).alias("n"), (F.max(score) - F.min(score)).alias("spread")).filter("n >= 2")


def noise_floor(spread: DataFrame, keys: list[str]) -> DataFrame:
    return spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_configs"), F.min("spread").alias("min_spread"), F.max("spread").alias("max_spread"), F.avg("spread").alias("mean_spread"))


def tie_call(diff: Column, floor: float) -> Column:
    return F.when(F.abs(diff) < floor, "tie").when(diff > 0, "better").otherwise("worse")
