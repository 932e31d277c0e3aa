import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import fm_index


def rows(found, name):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in fm_index.judged(found, name).collect()}


def test_query(spark, sf, docs, queries):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries["op1_decontamination"](spark, sf).collect()}
    assert got == brute.contaminated(docs, items)
    assert any(v[-1] for v in got.values())


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_blocks_and_odd_rows(spark, odd, block_bytes):
    items = [(1, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16 p17"), (2, "ONE"), (3, None), (4, "..."), (5, "p60 p61 p62 p63 p64 p65 p66 p67 p68 p69 end x y z"), (6, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd.where("doc_id is not null and found <> 'l'")
    found, name = fm_index.contamination(docs, bench, block_bytes=block_bytes)
    assert name == "found_" and set(odd.columns) < set(found.columns)
    assert rows(found, name) == brute.contaminated([(r.doc_id, r.text) for r in docs.collect()], items)
    assert fm_index.contamination(odd, bench)[0].count() == odd.count()


def test_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.contamination(empty, none)[0].count() == 0
    assert fm_index.clean(odd, none).count() == odd.count()
    assert fm_index.clean(odd, none).columns == odd.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=30), min_size=1, max_size=6), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_index_finds_all(texts, phrase):
    index = fm_index.Index([np.array(t, np.int32) for t in texts], 4)
    hit, low, high = index.search(np.array([phrase]))
    at = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(hit) else []
    assert at == [int(index.starts[d]) + i for d, t in enumerate(texts) for i in range(len(t) - len(phrase) + 1) if t[i:i + len(phrase)] == phrase]
