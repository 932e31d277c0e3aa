import brute
import pytest

from assay.llm import block_anchors, sparse_suffixes

KINDS = [(block_anchors, 13), (sparse_suffixes, 50)]


@pytest.mark.parametrize("name,window", [("op2_substring_dedup", 13), ("op6_suffix_dedup", 50)])
def test_query(spark, sf, docs, queries, name, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries[name](spark, sf).collect()}
    assert got == brute.repeats(docs, window)
    assert any(v[1] for v in got.values())


@pytest.mark.parametrize("module,window", KINDS)
@pytest.mark.parametrize("chunk_bytes,bucket_words", [(12 << 20, 1 << 20), (500, 50)])
def test_odd_rows(spark, odd, module, window, chunk_bytes, bucket_words):
    docs = odd.where("doc_id is not null and found <> 'l'").repartition(3)
    got = module.without_repeats(docs, chunk_bytes=chunk_bytes, bucket_words=bucket_words).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in got} == brute.repeats([(r.doc_id, r.text) for r in docs.collect()], window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("module,window", KINDS)
def test_null_and_repeated_ids(spark, odd, module, window):
    got = module.without_repeats(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    null = next(r for r in got if r.doc_id is None)
    assert null.kept == "null id" and by[4].kept == "one" and by[9].kept == ""


@pytest.mark.parametrize("module,window", KINDS)
def test_empty(empty, module, window):
    assert module.without_repeats(empty).count() == 0


def test_spans_do_not_join_documents(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, passage), (3, passage)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in block_anchors.without_repeats(docs).collect()) == [(1, []), (2, [(0, 20)]), (3, [(0, 20)])]
