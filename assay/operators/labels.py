"""Parsing, filtering and encoding of label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import small_table

# The label policies and how many outputs each one needs per task.
POLICY_WIDTH = {"ones": 1, "zeros": 1, "mask": 1, "selftrained": 1, "multiclass": 3}


def clean_columns(df: DataFrame, renames: dict[str, str], drop: list[str] = ()) -> DataFrame:
    return df.withColumnsRenamed(renames).drop(*drop)


def extract_key(path: Column, pattern: str) -> Column:
    """First group of pattern, NULL where it does not match."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def patient_key(path: Column) -> Column:
    return extract_key(path, r"(patient\d+)")


def study_key(path: Column) -> Column:
    return extract_key(path, r"(patient\d+/study\d+)")


def derive_view(path: Column, given: Column | None = None) -> Column:
    name = F.lower(path)
    derived = F.when(name.contains("frontal"), "Frontal").when(name.contains("lateral"), "Lateral").otherwise("Unknown")
    return derived if given is None else F.coalesce(given, derived)


def remap_prefix(path: Column, src: str, dst: str) -> Column:
    return F.when(path.startswith(src), F.concat(F.lit(dst), F.substring(path, len(src) + 1, 1_000_000))).otherwise(path)


def resolve_base(df: DataFrame, key: str, rel: str, bases: list[str], listing: DataFrame, listed: str) -> DataFrame:
    """First base folder under which the file exists, NULL when it is under none."""
    tries = df.select(key, F.posexplode(F.array(*[F.concat(F.lit(b), F.col(rel)) for b in bases])).alias("_ord", listed))
    hits = tries.join(listing.select(listed).distinct(), listed)
    found = hits.groupBy(key).agg(F.min_by(listed, "_ord").alias("resolved"))
    return df.join(found, key, "left")


def one_hot(df: DataFrame, labels: str, names: list[str]) -> DataFrame:
    parts = F.split(labels, "[|]")
    return df.select("*", *[F.array_contains(parts, n).cast("int").alias(n) for n in names])


def map_taxonomy(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Rename values by a driver-side dict; values without an entry stay."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def finalize(df: DataFrame, split: str, path: Column, columns: list[str]) -> DataFrame:
    return df.withColumn("split", F.lit(split)).withColumn("path", path).select(*columns)


def name_contains(path: Column, word: str) -> Column:
    return F.lower(path).contains(word.lower())


def any_uncertain(tasks: list[str]) -> Column:
    return F.exists(F.array(*tasks), lambda v: F.coalesce(v == -1, F.lit(False)))


def curriculum(df: DataFrame, tasks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with an uncertain cell, rows without): disjoint and complete."""
    flag = any_uncertain(tasks)
    return df.filter(flag), df.filter(~flag)


def positive_list(names: list[str], none: str) -> Column:
    """Names of the columns equal to 1, joined; ``none`` when there are none."""
    kept = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(F.lit(none))


def task_layout(spark: SparkSession, tasks: list[str], default: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Policy, output width and slice start per task; configuration mistakes raise."""
    overrides = overrides or {}
    unknown = sorted(set(overrides) - set(tasks))
    if unknown:
        raise ValueError(f"policies given for unknown tasks {unknown}")
    if default == "mixed":
        missing = [t for t in tasks if t not in overrides]
        if missing:
            raise ValueError(f"policy 'mixed' must name every task, missing {missing}")
    rows, start = [], 0
    for pos, task in enumerate(tasks):
        policy = overrides.get(task, default)
        if policy not in POLICY_WIDTH:
            raise ValueError(f"unknown policy {policy!r} for task {task}")
        rows.append((pos, task, policy, POLICY_WIDTH[policy], start))
        start += POLICY_WIDTH[policy]
    return small_table(spark, rows, "pos int, task string, policy string, width int, start int")


def layout_of(cells: DataFrame, default: str, overrides: dict[str, str] | None = None, raw: str = "raw") -> DataFrame:
    """task_layout of the tasks that occur in long cells (task, raw), in name order, with how each is labelled.

    n_labelled and n_unsure count defined and uncertain cells. A policy for a task that no cell has raises, and so does
    'mixed' without one for a task that occurs. The cells are read once; the driver gets one row per task.
    """
    found = cells.filter(F.col("task").isNotNull()).groupBy("task").agg(F.count(raw).alias("n_labelled"), F.count_if(F.col(raw) == -1).alias("n_unsure"))
    rows = sorted(tuple(r) for r in found.collect())
    layout = task_layout(cells.sparkSession, [r[0] for r in rows], default, overrides)
    return layout.join(small_table(cells.sparkSession, rows, "task string, n_labelled bigint, n_unsure bigint"), "task")


def encode(raw: Column, policy: Column) -> Column:
    """Target of a 4-state cell under a policy; NULL means masked."""
    filled = F.coalesce(raw, F.lit(0))
    unsure = raw == -1
    return (
        F.when(policy == "ones", F.when(unsure, 1).otherwise(filled))
        .when(policy == "zeros", F.when(unsure, 0).otherwise(filled))
        .when(policy == "multiclass", F.when(unsure, 2).otherwise(filled))
        .when(policy.isin("mask", "selftrained"), F.nullif(filled, F.lit(-1)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label policy "), policy)))
    )


def policy_of(tasks: dict[str, str], task: Column) -> Column:
    """Policy of a task from a driver-side dict (a handful of entries, part of the plan)."""
    return F.create_map(*[F.lit(x) for kv in tasks.items() for x in kv])[task]


def split_policy(split: Column, task: Column, train: dict[str, str], other: dict[str, str]) -> Column:
    return F.when(split == "train", policy_of(train, task)).otherwise(policy_of(other, task))


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key: the one with the lowest ordinal. Combines map-side, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_first")).select(*keys, "_first.*")


def soft_fill(cells: DataFrame, soft: DataFrame, keys: list[str], target: str, ordinal: str, threshold: float | None = None, default: float = 1.0) -> DataFrame:
    """Fill missing targets with soft probabilities (first per key), ``default`` where there is none."""
    first = keep_first(soft.select(*keys, "prob", ordinal), keys, ordinal).select(*keys, F.col("prob").alias("_soft"))
    joined = cells.join(first, keys, "left")
    prob = F.coalesce("_soft", F.lit(default))
    fill = prob if threshold is None else (prob >= threshold).cast("double")
    return (
        joined.withColumn("filled", F.col(target).isNull())
        .withColumn("no_soft", F.col(target).isNull() & F.col("_soft").isNull())
        .withColumn(target, F.coalesce(F.col(target).cast("double"), fill))
        .drop("_soft")
    )


def binarize(encoded: Column, policy: Column, exclude_uncertain: bool = False) -> tuple[Column, Column]:
    """(y, excluded): class 2 and masked cells are positive, or left out of scoring."""
    unsure = F.when(policy == "multiclass", F.coalesce(encoded == 2, F.lit(True))).otherwise(encoded.isNull())
    y = F.when(unsure, 1).otherwise((encoded == 1).cast("int"))
    return y, (unsure if exclude_uncertain else F.lit(False))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def positive_share(neg: Column, pos: Column, unsure: Column) -> Column:
    """p_pos / (p_pos + p_neg) of a 3-class softmax."""
    top = F.greatest(neg, pos, unsure)
    e = [F.exp(z - top) for z in (neg, pos, unsure)]
    total = e[0] + e[1] + e[2]
    p_neg, p_pos = e[0] / total, e[1] / total
    return p_pos / F.greatest(p_pos + p_neg, F.lit(1e-12))


def smooth(target: Column, eps: float) -> Column:
    return target * (1 - eps) + 0.5 * eps


def contradictions(df: DataFrame, normal: Column, pathologies: list[str]) -> DataFrame:
    """Rows flagged normal that carry a positive or an uncertain pathology, with counts per pathology."""
    arr = F.array(*pathologies)
    flagged = df.filter(normal)
    return flagged.agg(
        F.count(F.lit(1)).alias("n_normal"),
        F.count_if(F.exists(arr, lambda v: F.coalesce(v == 1, F.lit(False)))).alias("n_with_positive"),
        F.count_if(F.exists(arr, lambda v: F.coalesce(v == -1, F.lit(False)))).alias("n_with_uncertain"),
        *[F.count_if(F.col(p) == 1).alias(f"pos_{p}") for p in pathologies],
    )
