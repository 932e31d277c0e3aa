"""Benchmark decontamination by an FM-index over each shard of training text.

Words of a shard become integers. Their suffix array gives the Burrows-Wheeler transform, held in a
wavelet matrix. Benchmark windows are searched backward, all at once, through its ranks; occurrences
are located by walking back to sampled suffix positions; their spans are merged per document.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from assay.llm.text import ALNUM, annotate, fresh_name, utf8
from assay.session import staged

#: Words in a window.
WINDOW = 13
#: Every so many positions keep their suffix position.
SAMPLE = 8
#: Bytes of benchmark text that are searched in one pass over the documents.
BLOCK_BYTES = 8 << 20


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; from the second round on only ties are sorted.

    symbols are below 2**21 for the fast start; every document must end in a symbol of its own.
    """
    n = len(symbols)
    s = symbols.astype(np.int64)
    if n == 0:
        return s
    if s.max() < 1 << 21:
        key, h = s << 42, 3
        key[:-1] |= s[1:] << 21
        key[:-2] |= s[2:]
    else:
        key, h = s.copy(), 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    key = key[order]
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(slots)))
        found = order if len(slots) == n else order[slots]
        rank[found] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] * n + rank[at + h]
        by = np.argsort(key)
        order[slots] = at[by]
        key = key[by]
        h *= 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)
        self.ones = int(ones.sum(dtype=np.int64))
        self.zeros = len(bits) - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Index:
    """FM-index of a sequence of documents. Symbol 0 ends a document; words count from 1."""

    def __init__(self, docs: list[np.ndarray], sigma: int):
        self.lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(self.lengths + 1) - 1
        n = int(ends[-1]) + 1 if len(docs) else 0
        self.starts = ends - self.lengths
        word = np.ones(n, bool)
        word[ends] = False
        seq = np.zeros(n, np.int64)
        seq[word] = np.concatenate(docs) if docs else []
        ordered = seq + (len(docs) - 1)
        ordered[ends] = np.arange(len(docs))
        sa = suffix_array(ordered)
        marked = np.zeros(n, bool)
        marked[::SAMPLE] = True
        marked[self.starts] = True
        self.sampled = Bits(marked[sa])
        self.samples = sa[marked[sa]]
        counts = np.bincount(seq, minlength=sigma + 1)
        self.first = np.append(0, np.cumsum(counts))
        self.levels: list[Bits] = []
        self.bits = max(1, int(sigma).bit_length())
        x = seq[sa - 1].astype(np.int32)
        at = np.zeros(sigma + 1, np.int64)
        symbols = np.arange(sigma + 1)
        for b in range(self.bits - 1, -1, -1):
            one = (x >> b) & 1 == 1
            level = Bits(one)
            self.levels.append(level)
            x = np.concatenate([x[~one], x[one]])
            at = self._down(level, (symbols >> b) & 1 == 1, at)
        self.base = at

    @staticmethod
    def _down(level: Bits, one: np.ndarray, i: np.ndarray) -> np.ndarray:
        r = level.rank(i)
        return np.where(one, level.zeros + r, i - r)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands in the transform before i."""
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels):
            i = self._down(level, (symbol >> b) & 1 == 1, i)
        return i - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases of one length: (phrase, low, high) of those that occur."""
        alive = np.arange(len(phrases))
        last = phrases[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            c = phrases[alive, j]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
        keep = low < high
        return alive[keep], low[keep], high[keep]

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier."""
        symbol = np.zeros(len(rows), np.int64)
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels):
            one = level.get(rows)
            symbol |= one.astype(np.int64) << b
            rows = self._down(level, one, rows)
        return self.first[symbol] + rows - self.base[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows in the sequence."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            there = self.sampled.get(at)
            out[todo[there]] = self.samples[self.sampled.rank(at[there])] + steps
            todo, at = todo[~there], self.back(at[~there])
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, by length, with the items they come from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = [name for name, _ in items]
        self.words: dict[bytes, int] = {}
        number = self.words
        found: dict[tuple, list[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [number.setdefault(w, len(number)) for w in text.translate(ALNUM).split()]
            if not ids:
                continue
            for i in range(max(1, len(ids) - window + 1)):
                of = found.setdefault(tuple(ids[i : i + window]), [])
                if not of or of[-1] != k:
                    of.append(k)
        self.by_length = []
        for length in sorted({len(p) for p in found}):
            some = [(p, of) for p, of in found.items() if len(p) == length]
            self.by_length.append((np.array([p for p, _ in some], np.int64), [of for _, of in some]))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[list, list, list]:
    """(words, spans, items) of each text."""
    fresh = count(1)

    class Numbers(dict):
        def __missing__(self, word):
            k = self[word] = next(fresh)
            return k

    numbers = Numbers()
    docs = []
    for text in texts:
        words = text.translate(ALNUM).split() if text else []
        docs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    n_words = [len(d) for d in docs]
    spans: list[list] = [[] for _ in docs]
    items: list[list] = [[] for _ in docs]
    if not numbers or not phrases.names:
        return n_words, spans, items
    index = Index(docs, len(numbers))
    to_shard = np.zeros(len(phrases.words), np.int64)
    for word, k in phrases.words.items():
        to_shard[k] = numbers.get(word, 0)
    edge = np.zeros(index.starts[-1] + index.lengths[-1] + 2, np.int32)
    named: list[set] = [set() for _ in docs]
    for table, of in phrases.by_length:
        mapped = to_shard[table]
        known = np.flatnonzero((mapped > 0).all(axis=1))
        hit, low, high = index.search(mapped[known])
        if not len(hit):
            continue
        size = high - low
        rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        at = index.locate(rows)
        edge += np.bincount(at, minlength=len(edge)).astype(np.int32)
        edge -= np.bincount(at + table.shape[1], minlength=len(edge)).astype(np.int32)
        doc = np.searchsorted(index.starts, at, side="right") - 1
        pairs = np.unique(np.repeat(known[hit], size) * len(docs) + doc)
        for phrase, d in zip((pairs // len(docs)).tolist(), (pairs % len(docs)).tolist()):
            named[d].update(of[phrase])
    covered = (np.cumsum(edge) > 0).astype(np.int8)
    turns = np.diff(covered, prepend=np.int8(0))
    begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    owner = np.searchsorted(index.starts, begin, side="right") - 1
    offset = index.starts[owner]
    for d, a, b in zip(owner.tolist(), (begin - offset).tolist(), (end - offset).tolist()):
        spans[d].append((a, b))
    for d, of in enumerate(named):
        items[d] = sorted({phrases.names[k] for k in of})
    return n_words, spans, items


SPAN = StructType([StructField("start", LongType(), False), StructField("end", LongType(), False)])
FIELDS = StructType([
    StructField("n_words", LongType(), False),
    StructField("spans", ArrayType(SPAN, False), False),
    StructField("item_ids", ArrayType(StringType(), False), False),
])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, name: str = "found") -> tuple[DataFrame, str]:
    """docs with a struct column of n_words, merged spans of benchmark words and ids of occurring items; and its name.

    Benchmark items are taken in blocks of about block_bytes, one pass over the documents each, so what
    a pass broadcasts stays bounded. A null or empty text has no words; an item without words matches
    nothing; an item with a null id counts as id ''. Rows are annotated in place: repeated rows and ids
    are kept as they are. An empty benchmark gives empty spans.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    name = fresh_name(docs, name)
    out = docs
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Phrases([(r.id, bytes(r.text)) for r in block.toLocalIterator()], window))
        last = name if k else None

        def make(shared=shared, last=last):
            def work(batch: pa.RecordBatch):
                n, spans, ids = search_shard(utf8(batch, text), shared.value)
                if last:
                    for j, old in enumerate(batch.column(last).to_pylist()):
                        spans[j] = _merge([*spans[j], *((s["start"], s["end"]) for s in old["spans"])])
                        ids[j] = sorted({*ids[j], *old["item_ids"]})
                return [n, [[{"start": a, "end": b} for a, b in s] for s in spans], ids]
            return work

        if k:
            again = fresh_name(out, name)
            out = annotate(staged(out, "spans"), again, FIELDS, make, text).drop(name).withColumnRenamed(again, name)
        else:
            out = annotate(out, name, FIELDS, make, text)
    return out, name


def judged(found: DataFrame, name: str) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated, taken from the struct column, which goes."""
    of = F.col(name)
    n_hit = F.aggregate(of["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (
        found.withColumn("n_words", of["n_words"])
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size(of["item_ids"]).cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", of["item_ids"]).cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
        .drop(name)
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    found, name = contamination(docs, benchmark, text=text)
    of = F.col(name)
    n_hit = F.aggregate(of["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.where((n_hit == 0) | (n_hit * 20 < of["n_words"])).drop(name)
