"""Aggregations and profiles of label tables, values and files."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.ordered import running, settled, with_ranks


def percent(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num * 100.0, den), F.lit(0.0))


def share(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.avg(p.cast("int")).alias(name) for name, p in predicates.items()])


STATES = {"pos": 1, "neg": 0, "unc": -1}


def label_states(cells: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Positive, negative, uncertain and blank cells with shares of all and of mentioned cells."""
    counts = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(raw) == v).alias(k) for k, v in STATES.items()],
        F.count_if(F.col(raw).isNull()).alias("blank"),
    )
    return _state_shares(counts)


def _state_shares(counts: DataFrame) -> DataFrame:
    mentioned = F.col("pos") + F.col("neg") + F.col("unc")
    out = counts.withColumn("mentioned", mentioned)
    for k in STATES:
        out = out.withColumn(f"{k}_of_all", percent(F.col(k), F.col("n"))).withColumn(f"{k}_of_mentioned", percent(F.col(k), mentioned))
    return out.withColumn("blank_of_all", percent(F.col("blank"), F.col("n")))


def label_states_total(cells: DataFrame, key: str, total: str = "ALL TASKS", raw: str = "raw") -> DataFrame:
    """label_states per key plus a grand total, shares recomputed from the summed counts."""
    counts = cells.rollup(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(raw) == v).alias(k) for k, v in STATES.items()],
        F.count_if(F.col(raw).isNull()).alias("blank"),
        F.grouping(key).alias("_g"),
    )
    named = counts.withColumn(key, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key))).drop("_g")
    return _state_shares(named)


def row_any(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one positive / negative / uncertain cell, all-blank and all-negative rows."""
    arr = F.array(*columns)

    def some(v):
        return F.exists(arr, lambda x: F.coalesce(x == v, F.lit(False)))

    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(some(1)).alias("any_pos"),
        F.count_if(some(0)).alias("any_neg"),
        F.count_if(some(-1)).alias("any_unc"),
        F.count_if(F.forall(arr, lambda x: x.isNull())).alias("all_blank"),
        F.count_if(F.forall(arr, lambda x: F.coalesce(x == 0, F.lit(False)))).alias("all_neg"),
    )


def policy_prevalence(cells: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    y = F.coalesce(F.col(raw), F.lit(0))
    return cells.groupBy(*keys).agg(
        (F.avg(y.isin(1, -1).cast("int")) * 100).alias("pct_ones"),
        (F.avg((y == 1).cast("int")) * 100).alias("pct_zeros"),
    )


def split_drift(cells: DataFrame, key: str, split: str, a: str, b: str, y: str) -> DataFrame:
    """Positives, share and negatives of two splits side by side, and the gap of the shares."""
    def side(name):
        here = F.col(split) == name
        pos, n = F.count_if(here & (F.col(y) == 1)), F.count_if(here)
        return [pos.alias(f"pos_{name}"), (n - pos).alias(f"neg_{name}"), percent(pos, n).alias(f"pct_{name}")]

    out = cells.groupBy(key).agg(*side(a), *side(b))
    return out.withColumn("gap", F.abs(F.col(f"pct_{a}") - F.col(f"pct_{b}")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value, NULL being a value of its own."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(column, "n", percent(F.col("n"), counts.agg(F.sum("n")).scalar()).alias("pct"))


def structure_stats(df: DataFrame, group: str, sub: str) -> DataFrame:
    """Groups, sub-groups, items; sub-groups per group and items per sub-group."""
    per_sub = df.groupBy(group, sub).agg(F.count(F.lit(1)).alias("items"))
    per_group = per_sub.groupBy(group).agg(
        F.count(F.lit(1)).alias("subs"), F.sum("items").alias("items"), F.max("items").alias("most"), F.count_if(F.col("items") > 1).alias("multi")
    )
    return per_group.agg(
        F.sum("items").alias("n_items"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("subs").alias("n_subs"),
        (F.sum("subs") / F.count(F.lit(1))).alias("subs_per_group"),
        F.max("subs").alias("max_subs"),
        (F.sum("items") / F.sum("subs")).alias("items_per_sub"),
        F.max("most").alias("max_items"),
        F.sum("multi").alias("n_multi"),
        (F.sum("multi") * 100.0 / F.sum("subs")).alias("pct_multi"),
    )


def value_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ordinals(df: DataFrame, keys: list[str], value: str, **kw) -> DataFrame:
    """(value, n, below, total): the value histogram with the rows below each value."""
    counts = settled(value_table(df, keys, value), "values")
    placed = running(counts, keys, value, {"below": ("sum", "n")}, stored=True, **kw)
    total = F.sum("n").alias("total")
    return placed.join(settled(counts.groupBy(*keys).agg(total), "totals"), keys) if keys else placed.withColumn("total", counts.agg(total).scalar())


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float], **kw) -> DataFrame:
    """Linearly interpolated percentiles from the value histogram: no group is buffered whole."""
    table = ordinals(df, keys, value, **kw)
    aggs = []
    for p in ps:
        pos = (F.col("total") - 1) * p
        low, high = F.floor(pos), F.ceil(pos)
        inside = (F.col("below") <= low) & (low < F.col("below") + F.col("n"))
        inside_high = (F.col("below") <= high) & (high < F.col("below") + F.col("n"))
        v = F.col(value).cast("double")
        lo, hi, frac = F.max(F.when(inside, v)), F.max(F.when(inside_high, v)), F.max(pos - low)
        aggs.append((lo + (hi - lo) * frac).alias(_pname(p)))
    return table.groupBy(*keys).agg(*aggs)


def _pname(p: float) -> str:
    return ("p%g" % (p * 100)).replace(".", "_")


def weighted_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float], **kw) -> DataFrame:
    """Smallest value whose cumulative count reaches p of the total (the minimum for p = 0)."""
    table = ordinals(df, keys, value, **kw)
    reach = F.col("below") + F.col("n")
    return table.groupBy(*keys).agg(*[F.min(F.when(reach >= F.col("total") * p, F.col(value))).alias(_pname(p)) for p in ps])


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def numeric_summary(df: DataFrame, column: str, above: float, **kw) -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.count_if(c == 0).alias("n_zero"),
        F.count_if(c > above).alias("n_above"), F.count_if(c.isNull()).alias("n_missing"),
    ).withColumn("median", exact_percentiles(df, [], column, [0.5], **kw).scalar())


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal bins over [lo, hi], the last one closed; empty bins are listed with 0."""
    width = (hi - lo) / bins
    c = F.col(column)
    bin_no = F.least(F.floor((c - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(c.between(lo, hi)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def grid_density(df: DataFrame, x: str, y: str, step: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / step).alias("gx"), F.floor(F.col(y) / step).alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values with share and running sum of the rounded shares."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), *columns).limit(k)
    w = Window.orderBy(F.desc("n"), *columns)  # k rows
    out = top.withColumn("pct", F.bround(F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar(), 2))
    return out.withColumn("rank", F.row_number().over(w)).withColumn("cum_pct", F.sum("pct").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def arg_extremes(df: DataFrame, measure: Column, tie: str, columns: list[str]) -> DataFrame:
    """Rows with the smallest and the largest measure, the first by ``tie`` among equals."""
    rows = df.withColumn("_m", measure)
    low = F.min(F.struct(F.col("_m").alias("measure"), F.col(tie), *[c for c in columns if c != tie]))
    high = F.min(F.struct((-F.col("_m")).alias("minus"), F.col("_m").alias("measure"), F.col(tie), *[c for c in columns if c != tie]))
    one = rows.agg(low.alias("lo"), high.alias("hi"))
    fields = ["measure", *columns]
    return one.select(*[F.col(f"lo.{c}").alias(f"min_{c}") for c in fields], *[F.col(f"hi.{c}").alias(f"max_{c}") for c in fields])


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Co-occurrence of 0/1 columns: counts, P(b given a) in % and phi, from one aggregation.

    Each pair is one conditional sum over the row, so no item is joined with itself.
    """
    ones = {c: (F.col(c) == 1).cast("bigint") for c in columns}
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(ones[c]).alias(f"s_{c}") for c in columns]
    aggs += [F.sum(ones[a] * ones[b]).alias(f"s_{a}_{b}") for a, b in combinations(columns, 2)]
    sums = df.agg(*aggs)
    cells = []
    for a in columns:
        for b in columns:
            both = f"s_{a}" if a == b else (f"s_{a}_{b}" if columns.index(a) < columns.index(b) else f"s_{b}_{a}")
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(both).alias("n_both"), F.col(f"s_{a}").alias("sa"), F.col(f"s_{b}").alias("sb"), F.col("_n").alias("n")))
    long = sums.select(F.inline(F.array(*cells)))
    n, sa, sb, both = (F.col(c).cast("double") for c in ("n", "sa", "sb", "n_both"))
    phi = F.try_divide(n * both - sa * sb, F.sqrt(sa * (n - sa) * sb * (n - sb)))
    return long.select("a", "b", "n_both", F.bround(F.try_divide(100.0 * both, sa), 1).alias("pct_b_given_a"), phi.alias("phi"))


def correlations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one grouped aggregation."""
    pairs = list(combinations(columns, 2))
    sums = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return sums.select(*keys, F.inline(F.array(*cells)))


def cardinality(df: DataFrame, columns: list[str], normal: Column) -> DataFrame:
    arr = F.array(*columns)
    df = df.withColumn("_k", F.size(F.filter(arr, lambda v: v == 1)))
    any_pos, all_neg = F.col("_k") > 0, F.forall(arr, lambda v: F.coalesce(v != 1, F.lit(True)))
    return df.agg(
        F.min("_k").alias("min_labels"), F.max("_k").alias("max_labels"), F.avg("_k").alias("mean_labels"),
        F.count_if(any_pos).alias("any_pos"), F.count_if(all_neg).alias("all_neg"),
        F.count_if(all_neg & normal).alias("all_neg_normal"), F.count_if(all_neg & ~normal).alias("other_only"),
    )


def distribution(df: DataFrame, keys: list[str], value: str, **kw) -> DataFrame:
    """Moments, percentiles, bias-corrected skewness and the share below one half."""
    c = F.col(value)
    n = F.count(c).cast("double")
    moments = df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        (F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.avg((c < 0.5).cast("int")).alias("below_half"),
    )
    return moments.join(exact_percentiles(df, keys, value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], **kw), keys)


def ecdf(df: DataFrame, keys: list[str], value: str, **kw) -> DataFrame:
    t = ordinals(df, keys, value, **kw)
    return t.select(*keys, value, ((F.col("below") + F.col("n")) / F.col("total")).alias("ecdf"))


def positives_at(df: DataFrame, keys: list[str], score: str, calibrated: DataFrame, on: list[str]) -> DataFrame:
    """Rows at or above 0.5 and at or above the calibrated cut where one is known."""
    j = df.join(settled(calibrated.select(*on, "threshold"), "cuts"), on, "left")
    s, n = F.col(score), F.count(F.lit(1))
    half, cal = F.count_if(s >= 0.5), F.count_if(s >= F.col("threshold"))
    known = F.max("threshold").isNotNull()
    return j.groupBy(*keys).agg(
        n.alias("n"), half.alias("n_half"), percent(half, n).alias("pct_half"),
        F.when(known, cal).alias("n_calibrated"), F.when(known, percent(cal, n)).alias("pct_calibrated"),
    )


def rank_columns(df: DataFrame, keys: list[str], columns: list[str], **kw) -> DataFrame:
    """Replace each column by its average rank within the group; all are ranked in one pass."""
    ranks = {c: f"_r_{c}" for c in columns}
    out = with_ranks(df, keys, ranks, **kw)
    return out.withColumns({c: F.col(r) for c, r in ranks.items()}).drop(*ranks.values())


def table_health(df: DataFrame, key: str | None = None) -> DataFrame:
    """Nulls per column and duplicated keys, in one pass over the table."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    n = df.agg(F.count(F.lit(1)).alias("n"), *nulls)
    if key is None:
        return n
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1))
    return n.withColumn("n_duplicates", copies.scalar())


def shard_profile(df: DataFrame, keys: list[str], size: str, mode: str, bad: Column) -> DataFrame:
    """Counts, modes and size buckets of files; merging across shards is Spark's partial aggregation."""
    per_mode = df.groupBy(*keys, mode).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.count_if(bad).alias("bad"))
    return per_mode.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("size").alias("total_size"), F.sum("bad").alias("n_bad"), F.count(F.lit(1)).alias("n_modes"), F.max_by(mode, F.struct("n", mode)).alias("top_mode")
    )


def profile_state(df: DataFrame, shard: str, keys: list[str], size: str, mode: str, bad: Column) -> DataFrame:
    """What a shard's profile needs to be merged later: one typed row per (shard, keys, mode value), NULL modes too."""
    return df.groupBy(shard, *keys, F.col(mode).alias("mode")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(size).cast("decimal(38,0)")).alias("size"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(bad).alias("n_bad")
    )


def store_profile(state: DataFrame, path: str, shard: str) -> None:
    """Add shards to a stored profile; a shard that is there already is replaced, all others stay."""
    state.repartition(F.col(shard), F.pmod(F.xxhash64(*state.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)


def merged_profile(state: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sizes, number of modes and commonest mode (the larger among equals) over all stored shards.

    The work is that of the states, not of the files behind them. A NULL mode counts as rows but is no mode.
    """
    modes = state.groupBy(*keys, "mode").agg(*[F.sum(c).alias(c) for c in ("n", "size", "n_bad")], F.min("least").alias("least"), F.max("most").alias("most"))
    common = F.max(F.when(F.col("mode").isNotNull(), F.struct("n", "mode")))["mode"]
    return modes.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("size").alias("total_size"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n_bad").alias("n_bad"),
        F.count("mode").alias("n_modes"), common.alias("top_mode"),
    )


def tree_totals(files: DataFrame, path: str = "path", size: str = "length", pattern: str = r"^([^/]+)/") -> DataFrame:
    top = F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).alias("top")
    return files.groupBy(top).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("bytes"))
