import brute
import public_tokenizers as P
import pytest

import corpus_pipeline
from assay.llm import byte_bpe, fm_index, toxicity
from assay.llm.tokens_q import RANKS
from assay.llm.toxicity_q import trained


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """Ids after each stage, each stage written and read again."""
    where = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert made.columns == columns
        made.write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        out.append(docs)
    return out


def test_stages_follow_their_definitions(spark, sf, kept):
    docs, calm, single, apart, clean, coded = kept
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    model = trained(spark, sf, docs)
    scores = {r.doc_id: r.toxicity.predicted for r in toxicity.scored(docs, model)[0].collect()}
    assert {d for d, _ in rows(calm)} == {d for d, y in scores.items() if y == 0}
    assert {d for d, _ in rows(single)} == {d for d, v in brute.exact(rows(calm)).items() if v[2]}
    assert {d for d, _ in rows(apart)} == {d for d, v in brute.near(rows(single)).items() if v[1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {d for d, _ in rows(clean)} == {d for d, v in brute.contaminated(rows(apart), items).items() if not v[-1]}
    assert coded.count() == clean.count()
    assert {r.doc_id: r.decoded_sha256 for r in coded.collect()} == {d: brute.sha(t or "") for d, t in rows(clean)}


def test_run_is_the_last_stage(spark, sf, kept):
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(kept[-1].collect())


def test_stages_take_odd_documents(spark, sf, odd):
    docs = odd.withColumnRenamed("found", "lang")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs, sf).columns) == set(docs.columns)
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
