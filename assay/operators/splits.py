"""Group splits, folds, samples, draws and shards.

Assignments compare each row's own hash key with a few cut keys. The cuts come from ranking the
distinct keys once; the data rows are not joined, sorted or shuffled to learn where they belong.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.hashing import md5_bits, md5_key, mixed_each, poisson_each, unit_key
from assay.functions.ordered import row_index, running, settled


def _unit_keys(df: DataFrame, unit: str, seed) -> DataFrame:
    """One key per distinct unit that is not NULL, written once."""
    return settled(df.select(unit).filter(F.col(unit).isNotNull()).distinct().select(md5_key(seed, unit).alias("_key")), "keys")


def _placed_keys(df: DataFrame, unit: str, seed, **kw) -> DataFrame:
    return row_index(_unit_keys(df, unit, seed), [], "_key", "_pos", stored=True, **kw)


def _count_units(df: DataFrame, unit: str) -> Column:
    return df.select(F.count_distinct(unit)).scalar()


def group_holdout(df: DataFrame, group: str, fraction: float, seed, name: str = "held_out", **kw) -> DataFrame:
    """Hold out ceil(fraction * groups) whole groups, chosen by seeded hash order."""
    wanted = F.ceil(_count_units(df, group) * F.lit(fraction))
    cut = _placed_keys(df, group, seed, **kw).filter(F.col("_pos") < wanted).agg(F.max("_key")).scalar()
    return df.withColumn(name, F.coalesce(md5_key(seed, group) <= cut, F.lit(False)))


def kfold(df: DataFrame, unit: str, k: int, seed, name: str = "fold", **kw) -> DataFrame:
    """Near-equal folds over the units in seeded hash order: fold of position i is i * k div N.

    The cuts are written: the folded rows may be read by many jobs, and each would place all units anew.
    """
    keys = _unit_keys(df, unit, seed)
    n = keys.select(F.count(F.lit(1))).scalar()
    placed = row_index(keys, [], "_key", "_pos", stored=True, **kw).withColumn("_fold", F.floor(F.col("_pos") * k / n))
    starts = settled(placed.groupBy("_fold").agg(F.min("_key").alias("_key")).filter(F.col("_fold") > 0), "folds")  # k - 1 rows
    cuts = starts.agg(F.collect_list("_key")).scalar()
    key = md5_key(seed, unit)
    passed = [F.coalesce((F.get(cuts, F.lit(i)) <= key).cast("int"), F.lit(0)) for i in range(k - 1)]
    return df.withColumn(name, sum(passed, F.lit(0)))


def balanced_group_folds(df: DataFrame, group: str, labels: list[str], k: int, seed, name: str = "fold", groups_per_bucket: int = 4096) -> DataFrame:
    """Folds over whole groups with about equal rows and positives of every label (a label column is 1 or not).

    Groups become histograms (rows, positives per label), dealt by hash into buckets of about ``groups_per_bucket``.
    In a bucket, groups with the rarest label come first, those with most of it before others; each goes to the
    fold that has least of that label, then fewest rows, then the first one counted from the bucket's own number. A
    group without positives goes by rows. A task holds a bucket's histograms and k of the folds, whatever the input.
    Between two folds of a bucket, the label that was dealt last differs by no more than its largest count in a
    group unless an earlier deal left more; over buckets differences cancel out. A NULL group is one group.
    """
    sums = [F.count_if(F.col(c) == 1).alias(f"_c{i}") for i, c in enumerate(labels)]
    groups = settled(df.groupBy(F.col(group).alias("_group")).agg(*sums, F.count(F.lit(1)).alias("_rows")), "groups")
    totals = groups.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(labels))]).first()
    buckets = max(1, -(-totals["n"] // groups_per_bucket))
    rare = sorted(range(len(labels)), key=lambda i: (totals[f"_c{i}"] or 0, i))
    at = F.lit(len(labels))
    for place in range(len(labels) - 1, -1, -1):
        at = F.when(F.col(f"_c{rare[place]}") > 0, F.lit(place)).otherwise(at)
    key = md5_key(seed, F.coalesce(F.col("_group").cast("string"), F.lit("")))
    dealt = groups.withColumns({"_rarest": at, "_key": key, "_bucket": F.pmod(md5_bits(key), F.lit(buckets)).cast("int")})

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["_bucket"].iloc[0])
        counts = pdf[[*[f"_c{i}" for i in rare], "_rows"]].to_numpy(np.int64)
        own = pdf["_rarest"].to_numpy()
        most = counts[np.arange(len(pdf)), own]
        have, turn = np.zeros((k, len(rare) + 1), np.int64), (np.arange(k) + bucket) % k
        folds = np.empty(len(pdf), np.int32)
        for row in np.lexsort((pdf["_key"].to_numpy(), -counts[:, -1], -most, own)):
            f = np.lexsort((turn, have[:, -1], have[:, own[row]]))[0]
            folds[row] = f
            have[f] += counts[row]
        return pd.DataFrame({"_group": pdf["_group"], "_fold": folds})

    folds = settled(dealt.groupBy("_bucket").applyInPandas(deal, f"_group {dict(groups.dtypes)['_group']}, _fold int"), "folds")
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, F.col("_fold").alias(name))


def simple_sample(df: DataFrame, unit: str, n: int, seed, **kw) -> DataFrame:
    """Exactly n rows (all when there are fewer), in seeded hash order of the unit; NULL is a unit.

    Of the unit at the cut as many rows are taken as are missing, in the order of a hash of the whole row.
    """
    if n <= 0:
        return df.limit(0)
    counts = settled(df.groupBy(md5_key(seed, unit).alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "units")
    placed = running(counts, [], "_key", {"_below": ("sum", "_n")}, stored=True, **kw)
    cut = placed.filter((F.col("_below") < n) & (F.col("_below") + F.col("_n") >= n)).select("_key", "_below").first()
    if cut is None:
        return df
    key = md5_key(seed, unit)
    last = df.filter(key == cut["_key"]).orderBy(F.xxhash64(*df.columns), *df.columns).limit(n - cut["_below"])
    return df.filter(key < cut["_key"]).unionByName(last)


def group_sample(df: DataFrame, group: str, n: int, seed, **kw) -> DataFrame:
    """All rows of n random groups; 0 means every group."""
    if n == 0:
        return df
    cut = _placed_keys(df, group, seed, **kw).filter(F.col("_pos") < n).agg(F.max("_key")).scalar()
    return df.filter(md5_key(seed, group) <= cut)


def epoch_order(df: DataFrame, unit: str, seed: int, epoch: int, skip: int = 0, **kw) -> DataFrame:
    """Position of each row in the epoch's permutation, without the first ``skip`` rows."""
    keyed = df.withColumn("_key", F.struct(md5_key(seed + epoch, unit).alias("h"), F.col(unit).alias("u")))
    return row_index(keyed, [], "_key", "position", stored=True, **kw).drop("_key").filter(F.col("position") >= skip)


def round_robin(df: DataFrame, order: str, shards: int, **kw) -> DataFrame:
    return row_index(df, [], order, "_pos", stored=True, **kw).withColumn("shard", F.pmod("_pos", F.lit(shards))).drop("_pos")


def chunks(df: DataFrame, order: str, size: int, **kw) -> DataFrame:
    return row_index(df, [], order, "_pos", stored=True, **kw).withColumn("shard", F.floor(F.col("_pos") / size)).drop("_pos")


def exact_draws(df: DataFrame, unit: str, reps: int, **kw) -> DataFrame:
    """(rep, unit, weight): how often each unit is drawn in N draws with replacement per replicate."""
    placed = settled(row_index(df.select(unit), [], unit, "_pos", stored=True, **kw), "placed")
    n = placed.count()
    drawn = placed.select(F.posexplode(mixed_each(*unit_key(F.col("_pos")), reps)).alias("rep", "_mixed"))
    # Draws of a position seldom meet before the shuffle: one shuffle by position serves both the count and the join.
    spread = drawn.select("rep", F.pmod(F.col("_mixed"), F.lit(n)).alias("_pos")).repartition("_pos")
    counts = spread.groupBy("rep", "_pos").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(placed, "_pos").select("rep", unit, "weight")


def _node_draws(draws: np.ndarray, leaf: int, leaves: int, size: int, units: int, seed: int) -> np.ndarray:
    """Of ``draws`` per replicate, those that reach ``leaf`` in a binary tree of ``leaves`` ranges of ``size`` units (the last may be shorter).

    Each inner node splits its draws by a binomial that is a function of seed, node and replicates alone, so all
    leaves agree on it without meeting.
    """
    low, high = 0, leaves
    while high - low > 1:
        mid = (low + high) // 2
        here, left = min(high * size, units) - low * size, (mid - low) * size
        to_left = np.random.Generator(np.random.Philox(np.random.SeedSequence((seed, low, high)))).binomial(draws, left / here)
        low, high, draws = (low, mid, to_left) if leaf < mid else (mid, high, draws - to_left)
    return draws


def tree_draws(df: DataFrame, unit: str, reps: int, seed: int = 0, units_per_leaf: int = 4096, **kw) -> DataFrame:
    """(unit, draws): per unit the times it is drawn in each of ``reps`` replicates of N draws of N units, as an array.

    The draws of a replicate go down a binary tree of ranges of units, split by binomials, and a range hands its
    own out evenly: the counts are multinomial and add up to N exactly. Neither draws nor (replicate, unit)
    rows are shuffled; a task holds the counts of one range, 2 bytes a replicate and unit. The unit is unique and not NULL.
    """
    size = int(units_per_leaf)
    placed = settled(row_index(df.select(unit), [], unit, "_pos", stored=True, **kw), "placed")
    n = placed.count()
    leaves = max(1, -(-n // size))

    def hand_out(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["_leaf"].iloc[0])
        first, here = leaf * size, min(size, n - leaf * size)
        reach = _node_draws(np.full(reps, n, np.int64), leaf, leaves, size, n, seed)
        random = np.random.Generator(np.random.Philox(np.random.SeedSequence((seed, leaf, leaves, 1))))
        counts = np.empty((here, reps), np.int16)
        for rep in range(reps):
            counts[:, rep] = np.bincount(random.integers(0, here, reach[rep]), minlength=here)
        return pd.DataFrame({unit: pdf[unit], "draws": list(counts[pdf["_pos"].to_numpy() - first])})

    leaf = F.floor(F.col("_pos") / size).alias("_leaf")
    return placed.select("*", leaf).groupBy("_leaf").applyInPandas(hand_out, f"{unit} {dict(df.dtypes)[unit]}, draws array<smallint>")


def each_draw(draws: DataFrame, unit: str) -> DataFrame:
    """(rep, unit, weight > 0) of tree_draws, generated in place."""
    return draws.select(unit, F.posexplode("draws").alias("rep", "weight")).filter("weight > 0").select("rep", unit, "weight")


def poisson_draws(df: DataFrame, key: str, reps: int) -> DataFrame:
    """(rep, key, weight > 0) with independent Poisson(1) weights: no shuffle at all."""
    weighed = df.withColumn("_weights", poisson_each(*unit_key(F.col(key)), reps))
    each = weighed.select(*df.columns, F.posexplode("_weights").alias("rep", "weight"))
    return each.filter(F.col("weight") > 0).withColumn("weight", F.col("weight").cast("int"))


def size_tier(size: Column, tiers: list[tuple[float, str]]) -> Column:
    """First tier, from the largest minimum down, whose minimum is reached."""
    out = F.lit(None)
    for minimum, name in sorted(tiers):
        out = F.when(size >= minimum, F.lit(name)).otherwise(out)
    return out


def tag_membership(df: DataFrame, key: str, lists: list[tuple[str, DataFrame]], missing: str = "MISSING") -> DataFrame:
    """Tag rows by the first id list that holds their key."""
    tagged = None
    for pos, (tag, ids) in enumerate(lists):
        one = ids.select(F.col(ids.columns[0]).alias(key), F.lit(pos).alias("_p"), F.lit(tag).alias("_t"))
        tagged = one if tagged is None else tagged.unionByName(one)
    first = tagged.groupBy(key).agg(F.min_by("_t", "_p").alias("_t"))
    return df.join(first, key, "left").withColumn("split", F.coalesce("_t", F.lit(missing))).drop("_t")


def leakage(df: DataFrame, group: str, split: str, splits: list[str]) -> DataFrame:
    """Groups shared by each pair of splits (0 everywhere when the split is clean)."""
    present = df.groupBy(group).agg(*[F.max((F.col(split) == s).cast("int")).alias(f"_{i}") for i, s in enumerate(splits)])
    pairs = list(combinations(range(len(splits)), 2))
    sums = present.agg(*[F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"_{a}_{b}") for a, b in pairs])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(splits[a]).alias("a"), F.lit(splits[b]).alias("b"), F.col(f"_{a}_{b}").alias("shared")) for a, b in pairs])))


def split_audit(df: DataFrame, split: str, group: str, positive: Column) -> DataFrame:
    """Rows, share, groups and prevalence per split and for the whole (split NULL)."""
    per = df.groupBy(split, group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(positive).alias("_p"))
    parts = per.groupBy(split).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.sum("_p").alias("n_positive"))
    whole = per.groupBy(group).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p")).agg(
        F.lit("ALL").alias(split), F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.sum("_p").alias("n_positive")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    both = parts.unionByName(whole)
    return both.withColumn("pct_rows", F.col("n_rows") * 100.0 / total).withColumn("prevalence", F.col("n_positive") / F.col("n_rows"))
