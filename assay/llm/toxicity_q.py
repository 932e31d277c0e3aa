"""Toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.llm import toxicity
from assay.llm.ppm import in_fold
from assay.llm.registry import query, table

FOLDS, HELD_OUT = 5, 0


def trained(spark, sf_dir, docs):
    """The classifier for docs, learned from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    return toxicity.fit(docs, labels)


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = toxicity.scored(docs, trained(spark, sf_dir, docs))
    of = F.col(name)
    return found.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), of["score"].alias("score"), of["predicted"].cast("int").alias("predicted"))
