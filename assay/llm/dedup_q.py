"""Exact and near dedup over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.llm import digest_runs, simhash
from assay.llm.registry import query, table


@query("op3_exact_dedup", """
    select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
      doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256
    from (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as h from documents)
""")
def op3_exact_dedup(spark, sf_dir):
    found, name = digest_runs.groups(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", F.col(f"{name}.*"))


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    found, name = simhash.groups(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", F.col(f"{name}.fingerprint"), F.col(f"{name}.component_id"))
