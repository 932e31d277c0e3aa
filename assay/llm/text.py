"""Row-wise annotation in Arrow batches, and words of UTF-8 texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of text handled at once inside a task. One longer text is handled alone.
SHARD_BYTES = 6 << 20

#: Bytes of an Arrow batch between Spark and Python. Texts are long, and rows alone do not bound a batch.
BATCH_BYTES = 6 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: A-Z to a-z, everything else unchanged.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: A-Z to a-z; ASCII that is neither letter nor digit to a space. Bytes from 0x80 on belong to words.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# bytes.split() splits at [\x20\x09-\x0D], which is what the operators call white space.


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where their text passes limit bytes; no row is cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts of a batch as bytes; null stays None."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES; a lower one stays."""
    now = spark.conf.get(BATCH, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def annotate(docs: DataFrame, name: str, fields: StructType, make: Callable[[], Callable[[pa.RecordBatch], list]], text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """docs with one more struct column ``name``.

    make() runs once per task; what it returns takes a batch and gives one column of values per field.
    Rows keep their other columns, so nothing has to be joined back.
    """
    bound_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField(name, fields, True)])
    inner = to_arrow_schema(fields)

    def run(batches):
        work = make()
        for batch in slices(batches, text, limit):
            columns = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(work(batch), inner)]
            made = pa.StructArray.from_arrays(columns, fields=list(inner))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
