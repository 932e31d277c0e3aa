"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint bits that go together are grouped into partitions. Two fingerprints within TAU bits agree to
within t_i bits in some partition i whenever the thresholds t_i add up to TAU - partitions + 1; each
fingerprint takes the thresholds (-1: not probed) that a dynamic programme finds cheapest from the counts of
partition values. Probes and indexed values that meet are verified; verified links give components.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assay.llm.groups import brought, components, numbered, order_of, spanning
from assay.llm.text import LOWER, annotate, fresh_name, utf8
from assay.session import staged

SHINGLE = 3
SEED = 42
TAU = 3
#: Fingerprints looked at when bits are grouped. The grouping changes cost, never results.
SAMPLE = 4096
#: Bits of a partition value that the counts are kept by, so they are at most 2**16 per partition.
COUNTED_BITS = 16
#: A partition value with more fingerprints than this is met in four finer values.
HEAVY = 1 << 15
#: What making one probe costs, in comparisons.
PROBE_COST = 30.0
#: Groups up to this size are compared pair by pair in one vector operation per lag.
SMALL = 64


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of one text; 0 if it has no words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        digests = xxhash.xxh64_digest(joined, SEED)
        n = 1
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:])])
        n = len(words) - SHINGLE + 1
    lanes = np.unpackbits(np.frombuffer(digests, np.uint8)).view(np.uint64).reshape(n, 8)
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    ones = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "simhash") -> tuple[DataFrame, str]:
    """docs with a struct column holding the long ``bits``; and its name."""
    name = fresh_name(docs, name)

    def make():
        return lambda batch: [[fingerprint(t) for t in utf8(batch, text)]]

    return annotate(docs, name, StructType([StructField("bits", LongType(), False)]), make, text), name


def bit_groups(sample: np.ndarray, parts: int) -> list[np.ndarray]:
    """Bit positions in partitions of nearly equal size, each grown from the bits that correlate most."""
    bits = ((sample[:, None].view(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits = np.vstack([bits, np.zeros(64), np.ones(64)])
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0))
    strength = np.abs(centred.T @ centred) / np.outer(norm, norm)
    np.fill_diagonal(strength, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        left = sorted(free)
        group = [max(left, key=lambda b: strength[b, left].max())]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: strength[b, group].sum()))
        free -= set(group)
        out.append(np.array(sorted(group)))
    return out


def value_of(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint at these positions, as one number."""
    u = fps.view(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for k, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.astype(np.int64)


def expected(counts: np.ndarray, width: int) -> np.ndarray:
    """[t, v]: fingerprints expected within t bits of a partition value whose counted bits are v, t = 0 .. TAU."""
    low = min(width, COUNTED_BITS)
    at = np.arange(1 << low)
    shell = [counts.astype(np.float64)]
    for t in range(1, TAU + 1):
        far = np.zeros(1 << low)
        for some in combinations(range(low), t):
            far += counts[at ^ sum(1 << b for b in some)]
        shell.append(far)
    rest = width - low
    return np.array([sum(shell[d] * sum(comb(rest, j) for j in range(t - d + 1)) for d in range(t + 1)) / 2.0**rest for t in range(TAU + 1)])


def thresholds(values: list[np.ndarray], costs: list[np.ndarray], widths: list[int]) -> np.ndarray:
    """[fingerprint, partition] thresholds from -1, adding up to TAU - partitions + 1, of least cost."""
    parts, n = len(values), len(values[0])
    top = TAU + 1  # sums are kept of t + 1, which add up to TAU + 1
    best = np.full((top + 1, n), np.inf)
    best[0] = 0
    steps = []
    for i in range(parts):
        low = min(widths[i], COUNTED_BITS)
        own = costs[i][:, values[i] & ((1 << low) - 1)]
        price = [np.zeros(n)] + [own[t] + PROBE_COST * sum(comb(widths[i], j) for j in range(t + 1)) for t in range(TAU + 1)]
        new = np.full((top + 1, n), np.inf)
        step = np.zeros((top + 1, n), np.int8)
        for s in range(top + 1):
            for t in range(s + 1):
                c = best[s - t] + price[t]
                better = c < new[s]
                new[s][better] = c[better]
                step[s][better] = t
        best = new
        steps.append(step)
    out = np.zeros((n, parts), np.int8)
    s = np.full(n, top)
    for i in range(parts - 1, -1, -1):
        t = steps[i][s, np.arange(n)]
        out[:, i] = t - 1
        s = s - t
    return out


def _near(values: np.ndarray, width: int, t: int) -> np.ndarray:
    """[fingerprint, probe]: all values within t bits."""
    masks = [sum(1 << b for b in some) for d in range(t + 1) for some in combinations(range(width), d)]
    return values[:, None] ^ np.array(masks, np.int64)[None, :]


def _grow(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join distinct fingerprints of one value as all links would.

    What has joined a component leaves the rest, so a dense group costs few comparisons.
    """
    u, v, left = [], [], fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:128], front[128:]
            at = np.full(len(left), -1)
            for k, f in enumerate(some):
                at[(np.bitwise_count(left ^ f) <= TAU) & (at < 0)] = k
            hit = at >= 0
            if hit.any():
                u.append(some[at[hit]])
                v.append(left[hit])
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate(u or [none]), np.concatenate(v or [none])


def _links(part: np.ndarray, key: np.ndarray, sub: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within the groups of equal (part, key, sub) of sorted rows."""
    n = len(fps)
    new = np.ones(n, bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    u, v = [], []
    for k in np.flatnonzero(size > SMALL):
        a, b = _grow(np.unique(fps[first[k] : first[k] + size[k]]))
        u.append(a)
        v.append(b)
    end = np.repeat(first + size, size)
    at = np.flatnonzero(np.repeat(size <= SMALL, size))
    for lag in range(1, SMALL):
        at = at[at + lag < end[at]]
        if not len(at):
            break
        a, b = fps[at], fps[at + lag]
        near = (np.bitwise_count(a ^ b) <= TAU) & (a != b)
        u.append(a[near])
        v.append(b[near])
    none = np.zeros(0, np.uint64)
    a, b = np.concatenate(u or [none]), np.concatenate(v or [none])
    return spanning(a.view(np.int64), b.view(np.int64)) if len(a) else (a.view(np.int64), b.view(np.int64))


LINK = StructType([StructField("u", LongType()), StructField("v", LongType())])
VALUE = StructType([StructField("part", LongType()), StructField("key", LongType()), StructField("sub", LongType()), StructField("bits", LongType())])
COUNT = StructType([StructField("part", LongType()), StructField("key", LongType()), StructField("n", LongType())])


def _frame(schema, *columns):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=schema.names)


def partitions_for(n: int) -> int:
    """Fewer, wider partitions for more fingerprints. Any number gives the same links."""
    return 4 if n <= 1 << 24 else 3 if n <= 1 << 31 else 2


def links(reps: DataFrame, parts: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """(u, v): links among the distinct ``bits`` of reps that connect what all pairs within TAU bits connect."""
    parts = parts or partitions_for(reps.count())
    sample = np.array([r.bits for r in reps.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE).collect()], np.int64)
    bits = bit_groups(sample, parts)
    widths = [len(b) for b in bits]
    mask = (1 << COUNTED_BITS) - 1

    def tally(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i in range(parts):
                value, n = np.unique(value_of(fps, bits[i]) & mask, return_counts=True)
                yield _frame(COUNT, np.full(len(value), i), value, n)

    counts = [np.zeros(1 << min(w, COUNTED_BITS), np.int64) for w in widths]
    for row in reps.select("bits").mapInArrow(tally, COUNT).groupBy("part", "key").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.part][row.key] = row.n
    shared = reps.sparkSession.sparkContext.broadcast(([expected(c, w) for c, w in zip(counts, widths)], counts))

    def probe(batches):
        costs, counted = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy()
            if not len(fps):
                continue
            values = [value_of(fps, b) for b in bits]
            limits = thresholds(values, costs, widths)
            for i in range(parts):
                # a value probed at 0 bits is the indexed one, so all values go out once, and the near ones of wider probes
                keys, who = [values[i]], [np.arange(len(fps))]
                for t in range(1, TAU + 1):
                    some = np.flatnonzero(limits[:, i] == t)
                    near = _near(values[i][some], widths[i], t)[:, 1:]
                    keys.append(near.ravel())
                    who.append(np.repeat(some, near.shape[1]))
                key, who = np.concatenate(keys), np.concatenate(who)
                crowded = counted[i][key & mask] / 2.0 ** max(0, widths[i] - COUNTED_BITS) > heavy
                yield _frame(VALUE, np.full((~crowded).sum(), i), key[~crowded], np.full((~crowded).sum(), -1), fps[who[~crowded]])
                if crowded.any():
                    rest = np.setdiff1d(np.arange(64), bits[i])
                    for j in range(TAU + 1):
                        own = rest[j :: TAU + 1]
                        finer = value_of(fps[who[crowded]], own) * (TAU + 1) + j
                        yield _frame(VALUE, np.full(crowded.sum(), i), key[crowded], finer, fps[who[crowded]])

    def verify(batches):
        held = None
        for batch in batches:
            rows = np.array([batch.column(c).to_numpy() for c in range(4)])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            change = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            held = rows[:, cut:]
            if cut:
                yield _frame(LINK, *_links(*rows[:3, :cut], rows[3, :cut].view(np.uint64)))
        if held is not None and held.shape[1]:
            yield _frame(LINK, *_links(*held[:3], held[3].view(np.uint64)))

    keys = ["part", "key", "sub"]
    met = reps.select("bits").mapInArrow(probe, VALUE)
    return met.repartition(*keys).sortWithinPartitions(*keys, "bits").mapInArrow(verify, LINK)


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, parts: int | None = None, heavy: int = HEAVY) -> tuple[DataFrame, str]:
    """The carried columns of docs and a struct of fingerprint, component_id and kept; and its name.

    One row per input row. component_id is the smallest id reachable over links of at most TAU bits (null
    if all ids of the component are null). kept marks the first row of a component by id, null ids last.
    Null and empty texts and texts of white space have fingerprint zero. An empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    marked, made = fingerprints(docs, text)
    rows, name = numbered(marked, {"bits": F.col(made)["bits"]}, carry, fresh_name(marked, "near"))
    of = F.col(name)
    reps = staged(rows.groupBy(of["bits"].alias("bits")).agg(F.min(order_of(F.col(doc_id), of["row"])).alias("least")), "reps")
    answers = reps.select("bits", "least")
    if reps.limit(2).count() > 1:
        linked = components(links(reps, parts, heavy))
        rooted = reps.join(linked, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
        rooted = staged(rooted, "rooted")
        best = rooted.groupBy("root").agg(F.min("least").alias("least"))
        answers = staged(rooted.select("bits", "root").join(best, "root").select("bits", "least"), "components")
    found, answer = brought(rows, name, "bits", answers)
    answer = F.col(answer)["least"]
    made = F.struct(
        F.lower(F.lpad(F.hex(of["bits"]), 16, "0")).alias("fingerprint"),
        answer["id"].alias("component_id"),
        (answer["row"] == of["row"]).alias("kept"),
    )
    return found.select(*carry, made.alias(name)), name


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs per near-duplicate group."""
    found, name = groups(docs, text, doc_id)
    return found.where(F.col(name)["kept"]).drop(name)
