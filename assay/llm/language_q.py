"""Language of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.llm import ppm
from assay.llm.registry import query, table

FOLDS, HELD_OUT = 4, 2


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = ppm.in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    model = ppm.fit(docs.where(~held))
    found, name = ppm.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col(f"{name}.*"))
