"""Step-ordered computations on metric logs: rolling values, best-so-far, top-k, cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.ordered import numbered, previous, running, settled, trailing


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, width: int = 50, name: str = "rolling", **kw) -> DataFrame:
    """Mean of the last ``width`` rows; the first rows average what there is."""
    return trailing(df, keys, order, width, {name: F.avg(value)}, **kw)


def changes(df: DataFrame, keys: list[str], order: str, column: str, **kw) -> DataFrame:
    """Rows whose column differs from the previous row's."""
    return previous(df, keys, order, {"_prev": column}, **kw).filter(F.col("_prev") != F.col(column)).withColumnRenamed("_prev", f"previous_{column}")


def delta_to_last(df: DataFrame, keys: list[str], order: str, value: str, name: str = "delta", **kw) -> DataFrame:
    """value minus the last non-null value before it; NULL for the first or an undefined value."""
    seen = running(df, keys, order, {"_last": ("last", value)}, **kw)
    return seen.withColumn(name, F.col(value) - F.col("_last")).drop("_last")


def counter_gains(df: DataFrame, keys: list[str], order: str, counters: list[str], **kw) -> DataFrame:
    """What each cumulative counter gained since the row before, under its own name.

    Counters begin at zero; a reading below the one before has begun again from zero (a restarted job), so it is a gain.
    """
    seen = previous(df, keys, order, {f"_p_{c}": c for c in counters}, **kw)
    gain = lambda c: F.when(F.col(c) < F.col(f"_p_{c}"), F.col(c)).otherwise(F.col(c) - F.coalesce(F.col(f"_p_{c}"), F.lit(0)))
    return seen.withColumns({c: gain(c) for c in counters}).drop(*[f"_p_{c}" for c in counters])


def retrieval_rates(gains: DataFrame, images: str, data: str, busy: str, elapsed: str) -> DataFrame:
    """Images and megabytes a second, and milliseconds of reading an image, from the gains of four counters (busy in nanoseconds)."""
    return gains.withColumns({
        "images_per_s": F.try_divide(F.col(images), F.col(elapsed)),
        "mb_per_s": F.try_divide(F.col(data) / 1e6, F.col(elapsed)),
        "ms_per_image": F.try_divide(F.col(busy) / 1e6, F.col(images)),
    })


def extreme_step(df: DataFrame, keys: list[str], order: str, value: str, mode: str = "max") -> DataFrame:
    """First step holding the extreme value, undefined values ignored."""
    signed = F.col(value) if mode == "max" else -F.col(value)
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(signed.alias("s"), (-F.col(order)).alias("o"))))
    out = df.groupBy(*keys).agg(best.alias("_b"))
    v = F.col("_b.s") if mode == "max" else -F.col("_b.s")
    return out.select(*keys, (-F.col("_b.o")).alias(order), v.alias(value))


def rolling_throughput(df: DataFrame, keys: list[str], order: str, images: str, wall: str, wait: str, width: int = 20, **kw) -> DataFrame:
    sums = trailing(df, keys, order, width, {"_i": F.sum(images), "_w": F.sum(wall), "_d": F.sum(wait)}, **kw)
    return (
        sums.withColumn("imgs_per_s", F.try_divide("_i", "_w"))
        .withColumn("wait_pct", F.try_divide(100.0 * F.col("_d"), F.col("_w")))
        .drop("_i", "_w", "_d")
    )


def top_n(df: DataFrame, keys: list[str], value: str, tie: str, n: int, mode: str = "max") -> DataFrame:
    """Best n rows per group, earlier ``tie`` first among equals, with the delta to the best.

    ``row_number() <= n`` is planned with a group limit below the shuffle, so each task sends at
    most n rows per group, however large a group is.
    """
    by = F.col(value).desc() if mode == "max" else F.col(value).asc()
    w = Window.partitionBy(*keys).orderBy(by, F.col(tie))
    top = df.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.withColumn("delta", F.col(value) - F.first(value).over(Window.partitionBy(*keys).orderBy("rank")))


def both_ends(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k highest and k lowest rows per group."""
    high = top_n(df, keys, value, tie, k, "max").withColumn("side", F.lit("top"))
    low = top_n(df, keys, value, tie, k, "min").withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def step_spacing(df: DataFrame, keys: list[str], order: str, **kw) -> DataFrame:
    """Per group: gaps between consecutive distinct steps, the smallest and the most frequent one."""
    gaps = previous(df.select(*keys, order).distinct(), keys, order, {"_prev": order}, **kw).withColumn("gap", F.col(order) - F.col("_prev")).filter("gap is not null")
    per = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    mode = F.max(F.struct(F.col("n"), (-F.col("gap")).alias("g")))
    return per.groupBy(*keys).agg(F.sum("n").alias("n_gaps"), F.min("gap").alias("min_gap"), (-mode["g"]).alias("mode_gap"), F.count(F.lit(1)).alias("n_distinct"))


def best_so_far(df: DataFrame, keys: list[str], order: str, value: str, mode: str = "max", phase: str | None = None, **kw) -> DataFrame:
    """Running best, whether the row strictly improves it, and rows since the last improvement.

    ``order`` counts rows (1, 2, ...), so the counter is a difference of positions. ``phase`` never falls; with it
    the counter also begins anew at the first row of a phase. One pass: the largest (value, -order) before a row is
    the first row with the best value, and the largest (phase, -order) the first row of the latest phase.
    """
    signed = (F.col(value) if mode == "max" else -F.col(value)).alias("s")
    back = (-F.col(order)).alias("o")
    marked = df.withColumn("_mark", F.when(F.col(value).isNotNull(), F.struct(signed, back)))
    before = {"_top": ("max", "_mark")}
    if phase:
        marked = marked.withColumn("_begin", F.struct(F.col(phase).alias("p"), back))
        before["_phase"] = ("max", "_begin")
    seen = running(marked, keys, order, before, **kw)
    improved = F.col("_mark").isNotNull() & (F.col("_top").isNull() | (F.col("_mark.s") > F.col("_top.s")))
    top = F.greatest("_top", "_mark")
    since = F.coalesce(-top["o"], F.lit(0))
    if phase:
        since = F.greatest(since, -F.greatest("_phase", "_begin")["o"] - 1)
    out = seen.withColumns({"improved": improved, "best": top["s"] if mode == "max" else -top["s"], "best_step": -top["o"], "no_improve": F.col(order) - since})
    return out.drop("_mark", "_begin", "_top", "_phase")


def _ends(tracked: DataFrame, keys: list[str], order: str, stops: Column) -> DataFrame:
    """Per group: best value and step at the first row that stops it, or at its last row; and the stop step."""
    state = F.struct(order, "best", "best_step")
    ends = tracked.groupBy(*keys).agg(F.min(F.when(stops, state)).alias("_stop"), F.max(state).alias("_last"))
    end = F.coalesce("_stop", "_last")
    return ends.select(*keys, end["best"].alias("best"), end["best_step"].alias("best_step"), F.col("_stop")[order].alias("stop_step"))


def early_stop(df: DataFrame, keys: list[str], order: str, value: str, patience: int, mode: str = "max", **kw) -> DataFrame:
    """Per group: best value and step reached before the stop, and the stop step (NULL: never)."""
    tracked = best_so_far(df, keys, order, value, mode, **kw)
    return _ends(tracked, keys, order, F.col("no_improve") >= patience)


def phased_tracker(
    df: DataFrame, keys: list[str], order: str, value: str, patience: int, phase: str, stops_from: int, sets: list[str], mode: str = "max", **kw
) -> DataFrame:
    """Early stopping over phases, and what every set scored at the best step.

    Phases before ``stops_from`` track the best but never stop a group, and patience begins anew with each phase.
    For each of ``sets`` the value at the best step, NULL where the set was not scored there; ``<set>_last_step``
    is then the last step before at which it was scored, and else the best step itself.
    """
    rows = df.withColumns({f"_at_{c}": F.when(F.col(c).isNotNull(), F.col(order)) for c in sets})
    tracked = best_so_far(rows.select(*keys, order, value, phase), keys, order, value, mode, phase, **kw)
    ends = settled(_ends(tracked, keys, order, (F.col("no_improve") >= patience) & (F.col(phase) >= stops_from)), "ends")
    # one row per group: small enough to be sent to the rows, or met by a join that splits a hot group
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = rows[order] <= F.col("_best_step")
    for i, k in enumerate(keys):
        same = same & (rows[k] == F.col(f"_k{i}"))
    upto = rows.join(ends.select(*own, F.col("best_step").alias("_best_step")), same)
    at_best = F.col(order) == F.col("_best_step")
    scored = upto.groupBy(*keys).agg(*[e for c in sets for e in (F.max(F.when(at_best, F.col(c))).alias(c), F.max(f"_at_{c}").alias(f"{c}_last_step"))])
    return ends.join(scored, keys, "left")


def top_board(df: DataFrame, keys: list[str], order: str, step: str, value: str, k: int, mode: str = "max") -> DataFrame:
    """Final top-k board: a step logged again replaces its old value, equal scores keep the earlier step."""
    latest = df.groupBy(*keys, step).agg(F.max_by(value, order).alias(value))
    return top_n(latest, keys, value, step, k, mode)


def cadence(step: Column, every: int, base: int = 1) -> Column:
    """Is this step scored? ``every`` must be a multiple of the base cadence."""
    if every % base:
        raise ValueError(f"cadence {every} is not a multiple of the base cadence {base}")
    return F.pmod(step, F.lit(every)) == 0


def phased_cadence(epoch: Column, switch: int, before: int, after: int) -> Column:
    """Steps between validations, from 1-based epoch ``switch`` on the second value."""
    return F.when(epoch >= switch, after).otherwise(before)


def stage_order(df: DataFrame, stage: str, order: str, configured: list[str]) -> DataFrame:
    """Stages present in the log: configured ones first, in order, then by first appearance."""
    first = df.groupBy(stage).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(s) for s in configured]), F.col(stage))
    w = Window.orderBy(F.when(place > 0, place).otherwise(len(configured) + 1), "first_seen", stage)  # one row per stage
    return first.withColumn("position", F.row_number().over(w))


def eta(elapsed: Column, step: Column, total: Column) -> Column:
    return F.try_divide(elapsed, step) * F.greatest(F.lit(0), total - step)


def leaderboard(df: DataFrame, split: str, run: str, score: str) -> DataFrame:
    """Rank runs per split: best first, missing scores last in name order."""
    return numbered(df, [split], score, run)
