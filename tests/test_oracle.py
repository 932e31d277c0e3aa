"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["low"] <= row["macro_auroc"] <= row["high"]


# Queries over ordered state and draws must not depend on how rows are spread.
@pytest.mark.parametrize("partitions", ["1", "37"])
@pytest.mark.parametrize("name", ["met_9_best_f1", "spl_5_kfold", "sta_1_bootstrap_chunked", "win_10_best_so_far_ranged", "jn_11_nearest_ranged", "spl_8_exact_draws"])
def test_partition_invariance(spark, sf, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
