"""Rows that share a value: numbered rows, answers brought back to them, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.text import fresh_name
from assay.session import staged


def numbered(docs: DataFrame, values: dict[str, Column], carry: list[str], name: str) -> tuple[DataFrame, str]:
    """The carried columns and a struct of run (a piece of the input), row (unique) and values, written once.

    Being written, run and row stay the same whatever is recomputed later.
    """
    name = fresh_name(docs, name)
    made = F.struct(F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), *[v.alias(k) for k, v in values.items()])
    return staged(docs.select(*carry, made.alias(name)), name), name


def order_of(doc_id: Column, row: Column) -> Column:
    """Rows by id, null ids last, equal ids by row."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), row.alias("row"))


def brought(rows: DataFrame, name: str, key: str, answers: DataFrame) -> tuple[DataFrame, str]:
    """rows with the columns of answers for their key in a struct, whatever share of the rows has one key; and its name.

    answers has one row per key, in a column of that name. A key is first answered once per run, then rows
    meet the answer of their run and key: a hot key is spread over all runs.
    """
    run_, key_, answer = (fresh_name(rows, n) for n in ("_run", "_key", "_answer"))
    leaf = rows.select(F.col(name)["run"].alias("run"), F.col(name)[key].alias(key)).distinct()
    known = leaf.join(answers, key)
    known = known.select(F.col("run").alias(run_), F.col(key).alias(key_), F.struct(*[c for c in answers.columns if c != key]).alias(answer))
    return rows.join(known, (F.col(name)["run"] == F.col(run_)) & (F.col(name)[key] == F.col(key_))).drop(run_, key_), answer


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) reduced to one link from each node to the smallest of its component among these links."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches, in alternating star rounds.

    In a large-star round the larger neighbours of each node move to the smallest; in a small-star round
    the others do. Rounds end when the edges no longer change; each round is written to the shared folder.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = staged(small.where("u <> v").distinct(), "edges")
        was, mark = mark, _mark(edges)
        if mark == was:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
