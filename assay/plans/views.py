"""Inputs derived from the given tables, in Spark and as SQL text for the oracle.

The tables hold no label matrices or predictions, so these are computed from their keys by
integer arithmetic: every derived row comes from a table row, and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.ordered import row_index

TASKS = ["t0", "t1", "t2", "t3", "t4"]
MEMBERS = ["m0", "m1", "m2", "m3"]
SPLITS = ["train", "val19k", "val200", "test500"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _each(values: list[str], number: str, name: str) -> str:
    return "inline(array(%s)) as (%s, %s)" % (", ".join(f"struct({i}, '{v}')" for i, v in enumerate(values)), number, name)


ITEM_COLUMNS = [
    "o_orderkey as item_id",
    "o_custkey as group_id",
    "concat('ds/train/patient', lpad(cast(o_custkey as string), 5, '0'), '/study', cast(o_orderkey % 7 as string), '/view',"
    " cast(o_orderkey as string), case when o_orderkey % 20 < 3 then '_lateral.jpg' else '_frontal.jpg' end) as path",
    "(o_orderkey * 13 + o_custkey) % 95 as age",
    "case when o_custkey % 5 < 3 then 'Male' else 'Female' end as sex",
    "case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 = 7 then 'val19k' when o_custkey % 10 = 8 then 'val200' else 'test500' end as split",
]


def _raw(t) -> str:
    h = f"(item_id * 31 + group_id * 17 + {t} * 13) % 10"
    return f"case when {h} < 2 then 1 when {h} = 2 then -1 when {h} < 5 then 0 end"


def _prob(m) -> str:
    top = f"(item_id * 7919 + group_id * 104729 + t * 131 + {m} * 15485863) % 1009 + (200 + 60 * {m}) * y"
    return f"cast({top} as double) / cast(1209 + 60 * {m} as double)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*ITEM_COLUMNS)


def label_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = items(spark, sf).selectExpr("item_id", "group_id", "path", "split", _each(TASKS, "t", "task"))
    return cells.selectExpr("*", f"{_raw('t')} as raw")


def wide_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per item with a label column per task."""
    return items(spark, sf).selectExpr("*", *[f"{_raw(t)} as {task}" for t, task in enumerate(TASKS)])


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return label_cells(spark, sf).selectExpr(
        "item_id", "group_id", "path", "split", "task", "t",
        "case when raw = 1 then 1 else 0 end as y", "coalesce(raw = -1, false) as uncertain",
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return targets(spark, sf).selectExpr("*", _each(MEMBERS, "m", "member")).selectExpr("*", f"{_prob('m')} as prob")


def wide_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (item, task) with a probability column per member."""
    return targets(spark, sf).selectExpr("*", *[f"{_prob(i)} as {m}" for i, m in enumerate(MEMBERS)])


def soft_labels(spark: SparkSession, sf: str) -> DataFrame:
    cells = label_cells(spark, sf).where("raw = -1 and item_id % 11 <> 0")
    return cells.selectExpr("item_id", "path", "task", "cast((item_id * 5011 + t * 37) % 1000 as double) / 1000 as prob")


def finding_sets(spark: SparkSession, sf: str) -> DataFrame:
    text = "concat_ws('|', case when item_id % 3 = 0 then 'A' end, case when item_id % 5 = 0 then 'B' end, case when item_id % 7 = 0 then 'C' end)"
    return items(spark, sf).selectExpr("item_id", f"coalesce(nullif({text}, ''), 'No Finding') as labels")


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """One row per logged metric: run, step (1, 2, ... in time order), stage, metric."""
    events = table(spark, sf, "events").selectExpr(
        "user_id as run", "struct(ts, event_id) as _at", "event_id", "ts", "event_type as stage", "value as metric"
    )
    return row_index(events, ["run"], "_at", "_i", stored=True).selectExpr("run", "_i + 1 as step", "stage", "metric", "event_id", "ts")


def run_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One score per (run, split): run = user, split = event type."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("split"))
        .agg((F.max("value") / 500).alias("score"), F.count(F.lit(1)).alias("n"))
    )


def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        p.alias("image_id"),
        (300 + (p * 37) % 5 * 30).alias("w"),
        (320 + (F.col("p_size") % 3) * 40).cast("bigint").alias("h"),
        (20 + F.col("p_size")).cast("bigint").alias("kib"),
    )


# The same inputs as SQL text; every oracle starts with them.
VIEWS_SQL = """
tasks as (select * from (values (0,'t0'),(1,'t1'),(2,'t2'),(3,'t3'),(4,'t4')) x(t,task)),
members as (select * from (values (0,'m0'),(1,'m1'),(2,'m2'),(3,'m3')) x(m,member)),
items as (
 select o_orderkey as item_id, o_custkey as group_id,
  concat('ds/train/patient', lpad(cast(o_custkey as varchar), 5, '0'), '/study', cast(o_orderkey % 7 as varchar), '/view',
   cast(o_orderkey as varchar), '_', case when o_orderkey % 20 < 3 then 'lateral' else 'frontal' end, '.jpg') as path,
  (o_orderkey * 13 + o_custkey) % 95 as age, case when o_custkey % 5 < 3 then 'Male' else 'Female' end as sex,
  case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 = 7 then 'val19k' when o_custkey % 10 = 8 then 'val200' else 'test500' end as split
 from orders),
label_cells as (
 select i.item_id, i.group_id, i.path, i.split, k.task, k.t,
  case when (i.item_id*31 + i.group_id*17 + k.t*13) % 10 < 2 then 1 when (i.item_id*31 + i.group_id*17 + k.t*13) % 10 = 2 then -1
       when (i.item_id*31 + i.group_id*17 + k.t*13) % 10 < 5 then 0 else null end as raw from items i cross join tasks k),
targets as (
 select item_id, group_id, path, split, task, t, case when raw = 1 then 1 else 0 end as y, (raw is not null and raw = -1) as uncertain from label_cells),
predictions as (
 select g.item_id, g.group_id, g.path, g.split, g.task, g.t, m.m, m.member, g.y, g.uncertain,
  cast((g.item_id*7919 + g.group_id*104729 + g.t*131 + m.m*15485863) % 1009 + (200 + 60*m.m)*g.y as double) / cast(1209 + 60*m.m as double) as prob
 from targets g cross join members m),
wide_predictions as (
 select item_id, group_id, path, split, task, t, y, uncertain,
  max(case when m = 0 then prob end) as m0, max(case when m = 1 then prob end) as m1, max(case when m = 2 then prob end) as m2, max(case when m = 3 then prob end) as m3
 from predictions group by all),
wide_labels as (
 select item_id, group_id, path, split, max(case when t=0 then raw end) as t0, max(case when t=1 then raw end) as t1, max(case when t=2 then raw end) as t2,
  max(case when t=3 then raw end) as t3, max(case when t=4 then raw end) as t4 from label_cells group by all),
soft_labels as (
 select item_id, path, task, cast((item_id*5011 + t*37) % 1000 as double)/1000 as prob from label_cells where raw = -1 and item_id % 11 <> 0),
finding_sets as (
 select item_id, coalesce(nullif(concat_ws('|', case when item_id%3=0 then 'A' end, case when item_id%5=0 then 'B' end, case when item_id%7=0 then 'C' end), ''),'No Finding') as labels from items),
metric_log as (
 select user_id as run, row_number() over (partition by user_id order by ts, event_id) as step, event_type as stage, value as metric, event_id, ts from events),
run_scores as (
 select user_id as run, event_type as split, max(value)/500 as score, count(*) as n from events group by 1, 2),
image_sizes as (
 select p_partkey as image_id, 300 + (p_partkey * 37) % 5 * 30 as w, cast(320 + (p_size % 3) * 40 as bigint) as h, cast(20 + p_size as bigint) as kib from part)
"""
