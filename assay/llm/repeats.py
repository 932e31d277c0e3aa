"""Word sequences that repeat across documents: shared steps of the two substring operators.

Documents are packed into chunks, written once. Every chunk proposes anchor keys; buckets of keys answer which
anchors other chunks share; around shared anchors chunks extend to whole windows; buckets of windows answer
the smallest document of each. What is exchanged are sorted arrays, one entry per key and chunk, so a
passage in a third of all documents costs one entry per chunk and no pairs.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.text import slices, utf8
from assay.session import staged

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 12 << 20
#: Words whose keys meet in one bucket, about.
BUCKET_WORDS = 1 << 20
#: Odd multipliers of the two window hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

CHUNK = "n_words long, ids binary, sizes binary, data binary"
ANCHORS = "bucket int, chunk long, n long, keys binary, indexed binary"
SHARED = "chunk long, bucket int, bits binary"
WINDOWS = "bucket int, chunk long, n long, high binary, low binary, docs binary, several binary, ids binary"
SMALLEST = "chunk long, high binary, low binary, docs binary, ids binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Words of some documents with hashes of all their windows. ids: null is the largest integer."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.ids = ids
        sizes = []
        for text in texts:
            own = text.split()
            sizes.append(len(own))
            self.words += own
        for word in set(self.words):
            numbers[word] = len(numbers)
        self.sizes = np.array(sizes, np.int64)
        n = len(self.words)
        at = np.fromiter(map(numbers.__getitem__, self.words), np.int32, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: words left in the document, this one included
        self.left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(n)
        self.powers, self.sums = [], []
        for seed, m in enumerate(MULTIPLIERS):
            word_hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in numbers), np.uint64, len(numbers))
            power = np.cumprod(np.full(n, m, np.uint64))
            self.sums.append(np.append(np.uint64(0), np.cumsum(word_hash[at] * power if n else np.zeros(0, np.uint64))))
            self.powers.append(np.cumprod(np.full(n, pow(m, -1, 1 << 64), np.uint64)))

    def hashes(self, k: int, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the k words from each position; of no meaning where the document is shorter."""
        sums, power = self.sums[which], self.powers[which]
        if at is not None:
            return mix((sums[at + k] - sums[at]) * power[at])
        if len(power) < k:
            return np.zeros(0, np.uint64)
        return mix((sums[k:] - sums[:-k]) * power[: len(power) - k + 1])

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.sizes, at, side="right")


class Anchors(ABC):
    """Which positions of a chunk are anchors, and which windows a shared anchor makes worth a look."""

    #: words of a window and of an anchor
    window: int
    words: int

    @abstractmethod
    def propose(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, object]:
        """(positions, whether each is indexed, anything for candidates())."""

    @abstractmethod
    def candidates(self, chunk: Chunk, at: np.ndarray, shared: np.ndarray, more: object) -> np.ndarray:
        """Starts of windows around the shared ones of the anchors at these positions."""


def pack(docs: DataFrame, text: str, doc_id: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of documents as compressed rows, written once, with a number each."""
    names = [f.split()[0] for f in CHUNK.split(", ")]

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", limit):
            texts = [t or b"" for t in utf8(batch, "text")]
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            words = sum(len(t.split()) for t in texts)
            row = [words, ids.tobytes(), sizes.tobytes(), press.compress(b"".join(texts))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(row)], names=names)

    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return staged(bare.mapInArrow(run, CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def unpack(row: dict) -> Chunk:
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"]) if sizes.sum() else b""
    ends = np.cumsum(sizes).tolist()
    return Chunk(ids, [data[a:b] for a, b in zip([0, *ends], ends)])


def _small(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bits each as the largest needs; width and number go before."""
    width = max(1, int(values.max()).bit_length()) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8]
    bits = np.unpackbits(raw, axis=1, count=width, bitorder="little")
    return bytes([width]) + len(values).to_bytes(7, "little") + np.packbits(bits.ravel(), bitorder="little").tobytes()


def _wide(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:8], "little")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8").ravel()


def _sorted(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of pairs by (high, low) and the first place of each distinct pair in it."""
    order = np.argsort(high)
    a, b = high[order], low[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # equal first hashes of different windows, or pairs out of order
        order = np.lexsort((low, high))
        a, b = high[order], low[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first = np.flatnonzero(np.append(True, ~same)) if len(high) else np.zeros(0, np.int64)
    return order, first


def _up(values: np.ndarray) -> bytes:
    """Ascending integers as differences."""
    return _small(np.diff(values, prepend=values[:1] * 0))


def _table(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _slots(keys: np.ndarray, drop: int, buckets: int) -> np.ndarray:
    """Where the slice of each bucket begins in ascending keys whose top bits are the bucket."""
    return np.searchsorted(keys >> np.uint64(drop), np.arange(buckets + 1, dtype=np.uint64))


class Plan:
    """Sizes that follow from the words of the whole input."""

    def __init__(self, total: int, bucket_words: int = BUCKET_WORDS):
        self.bucket_bits = max(0, (total // bucket_words).bit_length())
        self.buckets = 1 << self.bucket_bits
        # 8 bits beyond the words make one chance hit in some thousands; hits are verified
        self.key_bits = min(63, max(32, total.bit_length() + 8))
        # with the 64 bits of the first hash, one chance that any two of all windows agree in a million
        self.low_bits = min(32, max(16, 2 * total.bit_length() + 20 - 64))


def keys_of(chunk: Chunk, anchors: Anchors, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(keys ascending and distinct, whether each is indexed)."""
    at, indexed, _ = anchors.propose(chunk)
    key = chunk.hashes(anchors.words, 0, at) >> np.uint64(64 - plan.key_bits)
    marked = np.sort(key << np.uint64(1) | indexed)
    key = marked >> np.uint64(1)
    last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    return key[last], (marked[last] & np.uint64(1)).astype(bool)


def anchors_of(chunk: Chunk, anchors: Anchors, plan: Plan):
    """(positions, order of their keys, keys ascending and distinct, first of each, indexed, more)."""
    at, indexed, more = anchors.propose(chunk)
    key = chunk.hashes(anchors.words, 0, at) >> np.uint64(64 - plan.key_bits)
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(at), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    known = np.maximum.reduceat(indexed[order], first) if len(first) else np.zeros(0, bool)
    return at, order, ordered[first], first, known, more


def share(rows: pa.Table) -> pa.Table:
    """For a bucket: per chunk, which of its keys are indexed somewhere and stand in two chunks."""
    rows = rows.to_pylist()
    keys = [np.cumsum(_wide(r["keys"])) for r in rows]
    ends = np.cumsum([len(k) for k in keys])
    distinct, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    indexed = np.zeros(len(distinct), bool)
    indexed[at[np.concatenate([np.unpackbits(np.frombuffer(r["indexed"], np.uint8), count=r["n"]).astype(bool) for r in rows])]] = True
    hit = (indexed & (n > 1))[at]
    return _table(SHARED, [(r["chunk"], r["bucket"], np.packbits(h).tobytes()) for r, h in zip(rows, np.split(hit, ends[:-1]))])


def smallest(rows: pa.Table) -> pa.Table:
    """For a bucket of windows: the smallest document of each, to the chunks that hold a larger one."""
    rows = rows.to_pylist()
    high = np.concatenate([np.cumsum(_wide(r["high"])) for r in rows])
    low = np.concatenate([_wide(r["low"]) for r in rows])
    doc = np.concatenate([np.frombuffer(r["ids"], np.int64)[_wide(r["docs"]).astype(np.int64)] for r in rows])
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=r["n"]).astype(bool) for r in rows])
    ends = np.cumsum([r["n"] for r in rows])
    order, first = _sorted(high, low)
    least = np.empty_like(doc)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(doc))))
    late = several | (least < doc)
    out = []
    for r, end in zip(rows, ends.tolist()):
        own = np.flatnonzero(late[end - r["n"] : end]) + end - r["n"]
        if len(own):
            used, of = np.unique(least[own], return_inverse=True)
            out.append((r["chunk"], _up(high[own]), _small(low[own]), _small(of.astype(np.uint64)), used.tobytes()))
    return _table(SMALLEST, out)


def removed(docs: DataFrame, anchors: Anchors, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words joined by one space) and spans of removed words.

    A word goes if a window of ``anchors.window`` words of its document covers it whose word sequence also
    starts in a document with a smaller id. Words are runs of anything but white space. Null and empty
    texts have no words; null ids are one id larger than all others; rows that repeat an id do not
    remove each other's words. Other columns are not read. An empty table gives no rows.
    """
    chunks = pack(docs, text, doc_id, chunk_bytes)
    plan = Plan(chunks.agg(F.sum("n_words")).first()[0] or 0, bucket_words)
    drop = plan.key_bits - plan.bucket_bits

    def propose(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, indexed = keys_of(unpack(row), anchors, plan)
                cut = _slots(keys, drop, plan.buckets)
                out = [(b, row["chunk"], q - p, _up(keys[p:q]), np.packbits(indexed[p:q]).tobytes()) for b, (p, q) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if q > p]
                yield from _table(ANCHORS, out).to_batches()

    shared = chunks.mapInArrow(propose, ANCHORS).groupBy("bucket").applyInArrow(share, SHARED)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        for row in left.to_pylist():
            chunk = unpack(row)
            at, order, keys, first, indexed, more = anchors_of(chunk, anchors, plan)
            if not len(at):
                continue
            cut = _slots(keys, drop, plan.buckets)
            repeated = np.diff(np.append(first, len(at))) > 1
            hit = indexed & repeated
            for r in answers:
                p, q = cut[r["bucket"]], cut[r["bucket"] + 1]
                hit[p:q] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=q - p).astype(bool)
            flags = np.zeros(len(at), bool)
            flags[order] = np.repeat(hit, np.diff(np.append(first, len(at))))
            start = anchors.candidates(chunk, at, flags, more)
            if not len(start):
                continue
            high, low = chunk.hashes(anchors.window, 0, start), chunk.hashes(anchors.window, 1, start) >> np.uint64(64 - plan.low_bits)
            ids, doc = np.unique(chunk.ids, return_inverse=True)
            doc = doc[chunk.docs(start)]
            order, first = _sorted(high, low)
            least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            high, low = high[order[first]], low[order[first]]
            cut = _slots(high, 64 - plan.bucket_bits, plan.buckets) if plan.bucket_bits else np.array([0, len(high)])
            for b, (p, q) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if q > p:
                    used, of = np.unique(least[p:q], return_inverse=True)
                    several = np.packbits(most[p:q] > least[p:q]).tobytes()
                    out.append((b, row["chunk"], q - p, _up(high[p:q]), _small(low[p:q]), _small(of.astype(np.uint64)), several, ids[used].tobytes()))
        return _table(WINDOWS, out)

    windows = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(extend, WINDOWS)
    least = windows.groupBy("bucket").applyInArrow(smallest, SMALLEST)

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        none = np.zeros(0, np.uint64)
        high = np.concatenate([np.cumsum(_wide(r["high"])) for r in answers] or [none])
        low = np.concatenate([_wide(r["low"]) for r in answers] or [none])
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64)[_wide(r["docs"]).astype(np.int64)] for r in answers] or [none.astype(np.int64)])
        return pa.concat_tables([_kept(unpack(row), anchors.window, plan.low_bits, high, low, ids) for row in left.to_pylist()])

    return chunks.groupBy("chunk").cogroup(least.groupBy("chunk")).applyInArrow(cut_out, KEPT)


def _kept(chunk: Chunk, window: int, low_bits: int, high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> pa.Table:
    """The documents of a chunk without repeats, given the smallest documents of windows that larger ones repeat."""
    n = len(chunk.words)
    order = np.lexsort((low, high))
    high, low, ids = high[order], low[order], ids[order]
    late = np.zeros(0, np.int64)
    if len(high):
        start = np.flatnonzero(chunk.left >= window)
        own = chunk.hashes(window, 0, start)
        at = np.searchsorted(high, own)
        at[at == len(high)] = 0
        known = high[at] == own
        start, at = start[known], at[known]
        own_low, doc = chunk.hashes(window, 1, start) >> np.uint64(64 - low_bits), chunk.ids[chunk.docs(start)]
        hit = np.zeros(len(start), bool)
        todo = np.arange(len(start))
        while len(todo):  # once, but for windows that share a first hash
            hit[todo] |= (low[at[todo]] == own_low[todo]) & (ids[at[todo]] < doc[todo])
            more = np.minimum(at[todo] + 1, len(high) - 1)
            again = (more > at[todo]) & (high[more] == high[at[todo]])
            at[todo] = more
            todo = todo[again]
        late = start[hit]
    edge = np.bincount(late, minlength=n + window + 1) - np.bincount(late + window, minlength=n + window + 1)
    gone = np.cumsum(edge[:n]) > 0
    turn = np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    # a span ends with its document, even if the next document begins with one
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    bounds = np.unique(np.concatenate([begin, chunk.starts[(chunk.starts < n)][gone[chunk.starts[chunk.starts < n]]]])) if n else begin
    stop = np.minimum(end[np.searchsorted(end, bounds, side="right")], bounds + chunk.left[bounds]) if len(bounds) else bounds
    owner = chunk.docs(bounds)
    spans: list[list] = [[] for _ in chunk.ids]
    for d, a, b in zip(owner.tolist(), (bounds - chunk.starts[owner]).tolist(), (stop - chunk.starts[owner]).tolist()):
        spans[d].append({"start": a, "end": b})
    kept, count = [], []
    words, begin, size = chunk.words, chunk.starts.tolist(), chunk.sizes.tolist()
    for d, of in enumerate(spans):
        left, at = [], begin[d]
        for s in of:
            left += words[at : begin[d] + s["start"]]
            at = begin[d] + s["end"]
        left += words[at : begin[d] + size[d]]
        kept.append(b" ".join(left))
        count.append(size[d] - len(left))
    none = chunk.ids == np.iinfo(np.int64).max
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array(chunk.ids, mask=none), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])
