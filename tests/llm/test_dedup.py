import random

import brute
import numpy as np
import pytest

from assay.llm import digest_runs, groups, simhash


def test_exact_query(spark, sf, docs, queries):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries["op3_exact_dedup"](spark, sf).collect()}
    assert got == brute.exact(docs)


@pytest.mark.parametrize("fan_bits", [1, 2, 5])
def test_tree_rounds(spark, fan_bits):
    rows = [(i, f"text {i % 37}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    from pyspark.sql import functions as F

    norm = digest_runs.normalised(F.col("text"))
    numbered, name = groups.numbered(docs, {"digest": F.unhex(F.sha2(norm.cast("binary"), 256)), "size": F.octet_length(norm).cast("long"), "check": F.xxhash64(norm)}, ["doc_id"], "exact")
    got = {(r.least["id"], r.rows) for r in digest_runs.merged_runs(numbered, name, "doc_id", fan_bits).collect()}
    assert got == {(i, len(range(i, 500, 37))) for i in range(37)}


def test_exact_odd_rows(odd, empty):
    found, name = digest_runs.groups(odd)
    rows = [r.asDict() | r[name].asDict() for r in found.collect()]
    assert len(rows) == odd.count()
    by = {r["found"]: r for r in rows if r["found"]}
    assert by["i"]["keep_id"] == 5 and by["j"]["keep_id"] == 5 and by["e"]["group_size"] == 3
    assert by["a"]["keep_id"] == by["b"]["keep_id"] == 1
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 4) == [False, True]
    assert by["k"]["keep_id"] is None and by["k"]["kept"]
    kept = digest_runs.distinct_texts(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["text_sha256"] for r in rows})
    assert digest_runs.groups(empty)[0].count() == 0


def test_near_query(spark, sf, docs, queries):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries["op10_simhash"](spark, sf).collect()}
    assert got == brute.near(docs)


def linked(spark, fps, **options):
    """Components of fingerprints through the operator's links."""
    reps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(set(fps))], "bits long")
    got = groups.components(simhash.links(reps, **options)).collect()
    return {r.node: r.root for r in got}


@pytest.mark.parametrize("parts", [2, 3, 4])
@pytest.mark.parametrize("heavy", [simhash.HEAVY, 2])
def test_links_equal_all_pairs(spark, parts, heavy):
    draw = random.Random(parts)
    seeds = [draw.getrandbits(64) for _ in range(30)]
    fps = [s ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5))) for s in seeds for _ in range(12)]
    dense = draw.getrandbits(64)  # one large group within a few bits
    fps += [dense ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(7))) for _ in range(300)]
    fps = sorted({int(np.uint64(f).view(np.int64)) for f in fps})
    arr = np.array(fps, np.int64).view(np.uint64)
    label = {}
    for i, f in enumerate(fps):
        if f in label:
            continue
        todo = [i]
        label[f] = f
        while todo:
            k = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= 3):
                if fps[j] not in label:
                    label[fps[j]] = f
                    todo.append(j)
    got = linked(spark, [np.int64(f).view(np.uint64) for f in fps], parts=parts, heavy=heavy)
    assert {f: got.get(f, f) for f in fps} == label


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    for parts in (2, 3, 4):
        bits = simhash.bit_groups(fps[:100], parts)
        assert sorted(np.concatenate(bits).tolist()) == list(range(64))
        values = [simhash.value_of(fps, b) for b in bits]
        widths = [len(b) for b in bits]
        counts = [np.bincount(v & 0xFFFF, minlength=1 << min(w, 16)) for v, w in zip(values, widths)]
        limits = simhash.thresholds(values, [simhash.expected(c, w) for c, w in zip(counts, widths)], widths)
        assert ((limits.astype(int) + 1).sum(axis=1) == simhash.TAU + 1).all()


def test_near_odd_rows(odd, empty):
    found, name = simhash.groups(odd)
    rows = {r["found"]: r[name] for r in found.collect()}
    assert len(rows) == odd.count()
    assert rows["a"].fingerprint == "0" * 16 and rows["a"].component_id == rows["b"].component_id == 1
    assert rows["i"].component_id == rows["j"].component_id == 5 and rows["h"].component_id == 7
    assert sorted(r.kept for k, r in rows.items() if k in ("d", "l")) == [False, True]
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert simhash.groups(empty)[0].count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 999), (1000, 1000)], "u long, v long")
    assert {r.node: r.root for r in groups.components(edges).collect()} == {i: 0 for i in range(1, 201)} | {1000: 999}


def test_hot_key_is_answered_per_run(spark):
    from pyspark.sql import functions as F

    docs = spark.range(300).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1)).repartition(6)
    rows, name = groups.numbered(docs, {"k": F.col("k")}, ["id"], "own")
    answers = docs.groupBy("k").agg(F.count("*").alias("n"))
    got, answer = groups.brought(rows, name, "k", answers)
    assert got.count() == 300 and got.where(f"{answer}.n = 200").count() == 200
