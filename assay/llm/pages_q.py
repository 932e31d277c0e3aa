"""Main text of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.llm import wrapper
from assay.llm.registry import query, table


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    found, name = wrapper.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col(name)["text"]
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
