"""Readers for label tables, reports, thresholds, weights, logs, images and cached predictions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assay.functions.ordered import settled

METRICS = "auroc double, auprc double, f1 double, precision double, recall double, specificity double, n_pos bigint, n_excluded bigint, threshold double"
REPORT_SCHEMA = f"macro map<string,double>, per_task map<string,struct<{METRICS.replace(' double', ': double').replace(' bigint', ': bigint')}>>"
WEIGHT_SCHEMA = "combine_space string, members array<string>, weights_per_class map<string,map<string,double>>, class_weights map<string,map<string,double>>"


def read_label_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; an empty cell is NULL, a malformed row an error."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", mode="FAILFAST")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table if it exists, otherwise no rows of the same schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def read_tokens(spark: SparkSession, path: str, name: str = "token") -> DataFrame:
    """Whitespace-separated ids of a text file, each once."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias(name)).filter(F.col(name) != "").distinct()


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(run, split, task, metrics...) from JSON reports below run=/split= folders."""
    docs = spark.read.schema(REPORT_SCHEMA + ", run string, split string").json(path)
    return docs.select("run", "split", F.explode("per_task").alias("task", "m")).select("run", "split", "task", "m.*")


def read_macro(spark: SparkSession, path: str, metric: str) -> DataFrame:
    docs = spark.read.schema(REPORT_SCHEMA + ", run string, split string").json(path)
    return docs.select("run", "split", F.try_element_at("macro", F.lit(metric)).alias(metric))


def read_thresholds(spark: SparkSession, path: str, tasks: list[str]) -> DataFrame:
    """(run, task, threshold) of the runs whose file names every task; other runs give nothing."""
    docs = spark.read.schema("thresholds map<string,double>, run string").json(path)
    full = docs.filter(F.forall(F.array(*[F.lit(t) for t in tasks]), lambda t: F.map_contains_key("thresholds", t)))
    return full.select("run", F.explode("thresholds").alias("task", "threshold")).filter(F.col("task").isin(tasks))


def read_weights(spark: SparkSession, path: str, tasks: list[str], space: str | None = None) -> DataFrame:
    """(run, task, member, w): fitted weights, else reused ones, else 1/M for every member.

    A file made in another space, or lacking a weight for one of its members, raises.
    """
    docs = spark.read.schema(WEIGHT_SCHEMA + ", run string").json(path)
    if space is not None:
        clash = F.col("combine_space").isNotNull() & (F.col("combine_space") != space)
        docs = docs.withColumn("run", F.when(clash, F.raise_error(F.concat(F.lit("weights of another space in "), "run"))).otherwise(F.col("run")))
    given = F.coalesce("weights_per_class", "class_weights")
    each = docs.select("run", given.alias("_g"), F.size("members").alias("_m"), F.explode("members").alias("member"))
    each = each.select("*", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))
    w = F.try_element_at(F.try_element_at("_g", F.col("task")), F.col("member"))
    missing = F.raise_error(F.concat(F.lit("no weight for "), "member", F.lit(" on "), "task"))
    return each.select("run", "task", "member", F.when(F.col("_g").isNull(), 1.0 / F.col("_m")).when(w.isNull(), missing).otherwise(w).alias("w"))


def read_metric_log(spark: SparkSession, path: str, schema: str, metric: str) -> DataFrame:
    """step, epoch and one metric of a validation log; rows without the metric are dropped."""
    names = StructType.fromDDL(schema).names
    if metric not in names:
        raise ValueError(f"log has no column {metric!r}; columns are {names}")
    return spark.read.schema(schema).csv(path, header=True).select("run", "step", "epoch", metric).dropna(subset=[metric])


def list_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """Files of a tree with their sizes; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def missing_predictions(expected: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(cached.select(*keys).distinct(), keys, "left_anti")


def fill_predictions(spark: SparkSession, path: str, expected: DataFrame, score, schema: str, keys: tuple[str, ...] = ("split", "member")) -> DataFrame:
    """Score only the partitions that the cache lacks, then read the whole cache.

    ``score`` maps the expected rows of the missing partitions to rows of ``schema``.
    """
    cached = read_optional(spark, path, schema)
    # Stored, so that its size is known and the rows are not shuffled onto the few keys that are partitions.
    miss = settled(missing_predictions(expected, cached, list(keys)), "missing")
    todo = expected.join(miss, list(keys), "left_semi")
    score(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return spark.read.schema(schema).parquet(path)
