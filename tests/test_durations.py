import math

import pytest
from pyspark.sql import functions as F

from assay.functions.durations import duration_text, iso_text

CASES = [
    (0.0, "0s"), (45.0, "45s"), (59.4, "59s"), (59.5, "1m 00s"), (0.5, "0s"), (1.5, "2s"), (750.0, "12m 30s"), (3599.0, "59m 59s"), (3599.6, "1h 00m"),
    (8100.0, "2h 15m"), (86399.0, "23h 59m"), (86400.0, "1d 00h"), (97200.0, "1d 03h"), (1e9, "11574d 01h"), (-5.0, "-5s"),
    (None, "?"), (math.nan, "?"), (math.inf, "?"), (-math.inf, "?"),
]


def test_durations(spark):
    df = spark.createDataFrame(list(enumerate(v for v, _ in CASES)), "i int, s double").orderBy("i")
    assert [r[0] for r in df.select(duration_text(F.col("s"))).collect()] == [t for _, t in CASES]


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(12,2)"])
def test_other_types(spark, kind):
    df = spark.sql(f"select cast(v as {kind}) as s from values (61), (null), (7200) t(v)")
    assert {r[0] for r in df.select(duration_text(F.col("s"))).collect()} == {"1m 01s", "?", "2h 00m"}


def test_moments(spark):
    df = spark.sql("select timestamp_ntz'2024-03-01 09:05:07.9' as t union all select null")
    assert {r[0] for r in df.select(iso_text(F.col("t"))).collect()} == {"2024-03-01T09:05:07", None}
