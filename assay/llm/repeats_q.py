"""Substring dedup over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.llm import block_anchors, sparse_suffixes
from assay.llm.registry import query, table


def _sql(window: int) -> str:
    """Windows by text: of each, documents after the first lose its words."""
    return f"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    g as (select doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - {window - 2})) as i from w)),
    m as (select k, min(doc_id) as first from g group by k),
    gone as (select distinct doc_id, unnest(range(i, i + {window})) as p from g join m using (k) where first < doc_id),
    each as (select doc_id, p, ws[p] as word from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from w)),
    kept as (select e.doc_id, count(gone.p) as n_removed, string_agg(e.word, ' ' order by e.p) filter (where gone.p is null) as left_text from each e left join gone on e.doc_id = gone.doc_id and e.p = gone.p group by e.doc_id)
    select doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(left_text, '')) as kept_sha256 from w left join kept using (doc_id)
    """


def _digest(found):
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_substring_dedup", _sql(block_anchors.WINDOW))
def op2_substring_dedup(spark, sf_dir):
    return _digest(block_anchors.without_repeats(table(spark, sf_dir, "documents")))


@query("op6_suffix_dedup", _sql(sparse_suffixes.WINDOW))
def op6_suffix_dedup(spark, sf_dir):
    return _digest(sparse_suffixes.without_repeats(table(spark, sf_dir, "documents")))
