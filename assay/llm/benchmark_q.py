"""Benchmark decontamination over all documents."""

from __future__ import annotations

from assay.llm import fm_index
from assay.llm.registry import query, table


WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
WINDOW = fm_index.WINDOW


@query("op1_decontamination", f"""
    with d as (select doc_id, {WORDS} as ws from documents),
    b as (select item_id, {WORDS} as ws from benchmark),
    items as (select distinct item_id, size, array_to_string(ws[i:i + size - 1], ' ') as k
      from (select item_id, ws, least({WINDOW}, len(ws)) as size, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) as i from b where len(ws) > 0)),
    spots as (select doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') as k
      from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as i from d, (select distinct size from items))),
    hits as (select doc_id, i, size, item_id from spots join items using (size, k)),
    covered as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
    named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hits) group by doc_id)
    select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
      coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from d left join covered using (doc_id) left join named using (doc_id)
""")
def op1_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = fm_index.contamination(docs, table(spark, sf_dir, "benchmark"))
    return fm_index.judged(found, name).drop("text")
