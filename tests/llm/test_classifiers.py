import brute
import numpy as np
import pytest

from assay.llm import ppm, toxicity

MEDIUM = "/root/testdata/sf0.01"


def test_language_query_held_out(spark, queries):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries["op5_language_id"](spark, MEDIUM).collect()
    assert len(rows) == len(want)
    assert all(r.held_out == (brute.fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_ignores_held_out_rows(spark, sf, queries):
    import tempfile

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = tempfile.mkdtemp(prefix="assay-tests-")
    held = ppm.in_fold(F.col("doc_id"), 4, 2)
    docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).write.parquet(f"{other}/documents.parquet")
    run = lambda where: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in queries["op5_language_id"](spark, where).collect())
    assert run(other) == run(sf)


def slow_bits(model_texts, text, order=ppm.ORDER):
    """Code length of text under counts of model_texts, by the definition, with all contexts kept."""
    counts = {}
    for t in model_texts:
        data = bytes(order) + t.lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k:i], {}).setdefault(data[i], 0)
                counts[data[i - k:i]][data[i]] += 1

    def p(context, byte):
        own = counts.get(context)
        lower = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        if not own:
            return lower(byte)
        total = sum(own.values()) + len(own)
        if byte in own:
            return own[byte] / total
        return len(own) / total * lower(byte) / sum(lower(b) for b in symbols if b not in own)

    symbols = sorted({b for t in model_texts for b in t.lower().encode()} | {0}) + [256]
    data = bytes(order) + text.lower().encode()
    return sum(-np.log2(p(data[i - order:i], data[i] if data[i] in symbols else 256)) for i in range(order, len(data)))


def test_code_lengths_follow_the_definition(spark):
    texts = ["the cat sat on the mat", "that cat", "Tat"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    model = ppm.fit(docs)
    for text in ("the cat", "zzz that", "hat", "ça"):
        assert model.lengths([text])[0, 0] == pytest.approx(slow_bits(texts, text), rel=1e-4)


def test_all_contexts_of_many_languages_count(spark):
    """Sixteen languages in several scripts, one of them with a small share of the text."""
    import random

    draw = random.Random(5)
    texts = {}
    for k in range(16):
        letters = [chr(0x100 + 0x60 * k + j) for j in range(40)] + list(" ab")
        texts[f"l{k:02}"] = ["".join(draw.choice(letters) for _ in range(40 if k == 3 else 800)) for _ in range(2)]
    docs = spark.createDataFrame([(t, k) for k, own in texts.items() for t in own], "text string, lang string")
    model = ppm.fit(docs)
    assert model.langs == sorted(texts)
    for i, own in enumerate(texts.values()):
        seen = own[0][5:25]
        assert model.lengths([seen])[0, i] == pytest.approx(slow_bits(own, seen), rel=1e-4)


def test_language_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([("der Hund und die Katze", "de"), ("the dog and the cat", "en"), (None, "fr"), ("x", None)], "text string, lang string")
    model = ppm.fit(docs)
    assert model.langs == ["de", "en"]
    found, name = ppm.identified(odd, model)
    rows = [(r.text, r[name]) for r in found.collect()]
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und" and r.score == 0) == (not t or not t.strip()) for t, r in rows)
    assert ppm.fit(docs.where("false")) is None
    assert {r.language.lang_pred for r in ppm.identified(odd, None)[0].collect()} == {"und"}
    assert ppm.identified(empty, model)[0].count() == 0


def test_toxicity_query_held_out(spark, queries):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = queries["op4_toxicity"](spark, MEDIUM).collect()
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hot, cold = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[(a > b) + (a == b) / 2 for b in cold] for a in hot]) > 0.75  # a twentieth of the labels is wrong
    assert sum((s >= 0.5) == y for s, y in held) > 0.88 * len(held)


def test_learns_stems(spark):
    """Words that only labels tell are found by their stem, in texts that no label covers; copies are no evidence."""
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        words = [word() for _ in range(30)] + ([f"zorgl{word()}"] if toxic else [])
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    copied = "unusual copied harmless passage of certain words " + " ".join(word() for _ in range(20))
    for i in range(1200, 1300):
        rows.append((i, f"{copied} {i}"))
        labels.append((i, 1))
    rows.append((2000, "certain harmless passage of unusual words"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity.predicted for r in toxicity.scored(docs, model)[0].collect()}
    assert all(got[i] == (i % 8 == 0) for i in range(0, 1200, 3))
    assert got[2000] == 0


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    votes = np.zeros((4000, len(toxicity.VOTERS)), int)
    for j, right in ((0, 0.95), (1, 0.9), (6, 0.9)):
        said = np.where(rng.random(4000) < right, truth, ~truth)
        votes[:, j] = np.where(said, toxicity.TOXIC, toxicity.NONE)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post = dict(zip(map(tuple, patterns), toxicity.label_model(patterns, counts.astype(float))))
    guess = np.array([post[tuple(v)] for v in votes]) > 0.5
    assert (guess == truth).mean() > 0.93


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    found, name = toxicity.scored(odd, model)
    assert found.count() == odd.count()
    assert found.where(f"{name}.predicted = 1").count() == 0
    plain = spark.createDataFrame([(1, "you are an idiot"), (2, "a fine day")], "doc_id long, text string")
    assert [r.toxicity.predicted for r in toxicity.scored(plain, model)[0].orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.scored(empty, toxicity.fit(empty, none))[0].count() == 0
