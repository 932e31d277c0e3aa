"""Exact dedup by merging sorted runs of digests up a tree.

Each piece of the input is a run of (digest, smallest row, rows), sorted by digest. In every round the
runs of up to FAN_IN neighbours in the tree meet: run p keeps the slice of the digest space that its place
in the group names and takes that slice of its partners' runs. After the last round run p holds one
slice of all digests, merged; no task ever holds more than its slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.groups import brought, numbered, order_of
from assay.llm.text import fresh_name
from assay.session import staged

#: Bits of the run number that one round settles: 2 ** FAN_BITS runs meet.
FAN_BITS = 3


def normalised(text):
    """Runs of white space to one space; null to the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _merge(batches):
    """Merges a sorted partition: entries of one place and digest become one with the smallest row.

    An entry is merged only with entries whose digest, length and second hash all agree.
    """
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(c) for c in ("place", "digest", "size", "check")]
        new = np.ones(n, bool)
        if n > 1:
            same = np.ones(n - 1, bool)
            for k in keys:
                same &= pa.compute.equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same
        first = np.flatnonzero(new)
        total = np.add.reduceat(batch.column("rows").to_numpy(), first)
        out = batch.take(pa.array(first))
        out = out.set_column(out.schema.get_field_index("rows"), out.schema.field("rows"), pa.array(total, pa.int64()))
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None and held.num_rows:
        yield held


def merged_runs(rows: DataFrame, name: str, doc_id: str, fan_bits: int = FAN_BITS) -> DataFrame:
    """One entry per distinct text: digest, the smallest (id, row) and the number of rows."""
    of = F.col(name)
    last = rows.agg(F.max(of["run"])).first()[0] or 0
    bits = max(1, int(last).bit_length())
    entry = rows.select(of["run"].alias("place"), of["digest"].alias("digest"), of["size"].alias("size"), of["check"].alias("check"), order_of(F.col(doc_id), of["row"]).alias("least"))
    keys = ["place", "digest", "size", "check"]
    runs = entry.groupBy(*keys).agg(F.min("least").alias("least"), F.count("*").alias("rows"))
    slot = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = 0
    while done < bits:
        take = min(fan_bits, bits - done)
        # bits done .. done + take of the place now come from the digest; the others stay
        mask = ((1 << take) - 1) << done
        place = F.col("place").bitwiseAND(F.lit(~mask & 0x7FFFFFFF)).bitwiseOR(slot.bitwiseAND(F.lit(mask).cast("long")).cast("int"))
        moved = runs.withColumn("place", place)
        runs = moved.repartition(min(parts, 1 << bits), "place").sortWithinPartitions(*keys, "least").mapInArrow(_merge, moved.schema)
        done += take
    return runs


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """The carried columns of docs and a struct of keep_id, group_size, kept and text_sha256; and its name.

    One row per input row. Texts are equal when they agree after white space runs become one space; a
    null text counts as empty. The row with the smallest id stays, null ids last; of rows that repeat an
    id and text exactly one stays. An empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    norm = fresh_name(docs, "norm")
    ready = docs.withColumn(norm, normalised(F.col(text)))
    values = {"digest": F.unhex(F.sha2(F.col(norm).cast("binary"), 256)), "size": F.octet_length(norm).cast("long"), "check": F.xxhash64(norm)}
    rows, name = numbered(ready, values, carry, fresh_name(ready, "exact"))
    answers = staged(merged_runs(rows, name, doc_id).select("digest", "least", "rows"), "digests")
    found, answer = brought(rows, name, "digest", answers)
    of, answer = F.col(name), F.col(answer)
    made = F.struct(
        answer["least"]["id"].alias("keep_id"),
        answer["rows"].alias("group_size"),
        (answer["least"]["row"] == of["row"]).alias("kept"),
        F.lower(F.hex(of["digest"])).alias("text_sha256"),
    )
    return found.select(*carry, made.alias(name)), name


def distinct_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs per distinct text."""
    found, name = groups(docs, text, doc_id)
    return found.where(F.col(name)["kept"]).drop(name)
