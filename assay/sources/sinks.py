"""Writers with read-back checks, append-only logs, reports and versioned results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become NULL before they reach JSON."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def write_splits(df: DataFrame, path: str, split: str, group: str, key: str) -> DataFrame:
    """Write one folder per split, read it back, and return the audit of what is stored."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    spark = df.sparkSession
    stored = spark.read.schema(df.schema).parquet(path)

    def totals(d, tag):
        return d.groupBy(split).agg(F.count(F.lit(1)).alias(f"rows_{tag}"), F.count_distinct(key).alias(f"keys_{tag}"))

    per_group = stored.groupBy(group).agg(F.count_distinct(split).alias("_s"))
    shared = per_group.agg(F.count_if(F.col("_s") > 1)).scalar()
    audit = totals(df, "in").join(totals(stored, "out"), split, "full")
    ok = F.col("rows_in").eqNullSafe(F.col("rows_out")) & F.col("keys_in").eqNullSafe(F.col("keys_out"))
    return audit.withColumn("matches", ok).withColumn("n_shared_groups", shared)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_reports(per_task: DataFrame, macro: DataFrame, path: str, metrics: list[str], keys: tuple[str, ...] = ("run", "split")) -> None:
    """One JSON document per (run, split) with the macro and per-task blocks."""
    tasks = per_task.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("task", F.struct(*[finite(F.col(m)).alias(m) if t == "double" else F.col(m) for m, t in per_task.dtypes if m in metrics])))).alias("per_task"))
    means = [c for c in macro.columns if c not in keys]
    block = macro.select(*keys, F.create_map(*[x for c in means for x in (F.lit(c), finite(F.col(c)))]).alias("macro"))
    block.join(tasks, list(keys)).write.mode("overwrite").partitionBy(*keys).json(path)


def text_table(df: DataFrame, keys: list[str], line: Column, order: str) -> DataFrame:
    """The report as text: one formatted line per task, joined in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


def write_version(df: DataFrame, path: str, run_ts: str) -> None:
    """Results of one run in a folder of their own; an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/run_ts={run_ts}")


def latest_version(df: DataFrame, run_ts: str = "run_ts") -> DataFrame:
    return df.filter(F.col(run_ts) == df.agg(F.max(run_ts)).scalar())
