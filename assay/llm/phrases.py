"""Phrases of two and three words by dynamic itemset counting.

Texts become shards of coded words, and shards are scanned in a cycle, one shard a step. Words are counted
from the first step on. A pair is counted from the step after both its words have reached the threshold, a
triple from the step after both its pairs have, and each goes on for one full cycle, so lengths interleave
and every occurrence of an active phrase is seen in exactly one step. A pair that ends its cycle below the
threshold is forgotten with its places.

A chunk of text is one row: its words as numbers of the chunk's own vocabulary. What Spark knows of a word or
pair comes to the chunks that hold it by joins on the vocabulary and on the pairs counted there, so nothing is
broadcast, and a frequent word is one row per chunk wherever it is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assay.llm.text import bound_batches, slices, utf8
from assay.session import staged

#: Shards, and so steps, of a cycle.
SHARDS = 2
#: Bytes of text in a chunk, about; one longer text makes a longer chunk.
CHUNK = 16 << 20
UNKNOWN = "und"
#: Parts of a language that are ranked apart before they are ranked together.
PARTS = 16

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS + b"\t", bytes(range(97, 123)) + b"." * len(_SEPARATORS) + b" ")
_EDGE = 0  # the number of the place between two pieces in every vocabulary
_NEVER = np.iinfo(np.int32).max

CHUNKS = "chunk long, shard int, lang string, ids binary, words array<string>, counts array<int>"
PAIRS = "chunk long, shard int, a long, b long, start int, n long"
TRIPLES = "a long, b long, c long, n long"


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, with a full stop wherever a piece ends."""
    return b".".join(texts).translate(_FOLD).replace(b".", b" . ").split()


class _Chunk:
    """Words of one language so far, as numbers."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.number[b"."]
        self.ids: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        words = [*words_of(texts), b"."]
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))

    def row(self, chunk: int, shard: int, lang: str) -> dict:
        ids = np.concatenate(self.ids)
        counts = np.bincount(ids, minlength=len(self.number))[1:]
        words = [w.decode() for w in self.number][1:]
        return {"chunk": chunk, "shard": shard, "lang": lang, "ids": _packed(ids), "words": words, "counts": counts}


def _packed(ids: np.ndarray) -> bytes:
    """Byte planes, lowest first: the upper ones are nearly all zero."""
    return zstandard.compress(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def coded(docs: DataFrame, text: str, lang: str, shards: int, size: int) -> DataFrame:
    """One row per chunk and language: packed numbers of its words, and its vocabulary with counts."""
    bound_batches(docs.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made, open_, held, turn = 0, {}, 0, 0

        def out():
            nonlocal made, held, turn
            for key, chunk in open_.items():
                yield pa.RecordBatch.from_pylist([chunk.row((task << 32) + made, (task + turn) % shards, key)], schema)
                made += 1
            open_.clear()
            held, turn = 0, turn + 1

        for batch in slices(batches, "text"):
            by: dict[str, list[bytes]] = defaultdict(list)
            for own, value in zip(batch.column("lang").to_pylist(), utf8(batch, "text")):
                if value:
                    by[own].append(value)
                    held += len(value)
            for own, texts in by.items():
                open_.setdefault(own, _Chunk()).add(texts)
            if held >= size:
                yield from out()
        yield from out()

    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return rows.mapInArrow(run, CHUNKS)


def _reached(counts: list[Column], least: int) -> Column:
    """First step after which the running count is at the threshold."""
    total, out = F.lit(0), F.lit(None).cast("int")
    steps = []
    for step, n in enumerate(counts):
        total = total + n
        steps.append((step, total >= least))
    for step, hit in reversed(steps):
        out = F.when(hit, F.lit(step)).otherwise(out)
    return out


def counted_words(chunks: DataFrame, least: int, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words at the threshold (id, lang, word, f, reach), words per language (lang, n), and every chunk's own words.

    Words are active from the start, so step s counts those of shard s: the running counts are sums by shard.
    """
    own = chunks.select("chunk", "shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "_w"))
    own = own.select("chunk", "shard", "lang", (F.col("at") + 1).alias("at"), F.col("_w.words").alias("word"), F.col("_w.counts").alias("n"))
    sums = [F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"_n{s}") for s in range(shards)]
    per = own.groupBy("lang", "word").agg(F.sum("n").alias("f"), *sums)
    sizes = staged(chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    kept = per.where(F.col("f") >= least).select("lang", "word", "f", _reached([F.col(f"_n{s}") for s in range(shards)], least).alias("reach"), F.monotonically_increasing_id().alias("_m"))
    kept = staged(kept, "words")
    parts = (kept.agg(F.max(F.shiftright("_m", 33))).first()[0] or 0) + 1
    number = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright("_m", 33)
    return kept.withColumn("id", number).drop("_m"), sizes, own


def with_words(chunks: DataFrame, own: DataFrame, words: DataFrame) -> DataFrame:
    """Chunks with what is known of their own words: at, id and reach; other words are never active."""
    known = own.join(words, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "id", "reach")).alias("known"))
    return chunks.select("chunk", "shard", "ids").join(known, "chunk")


def _numbers(structs: pa.Array, *names: str) -> list[np.ndarray]:
    """Fields of an array of structs as numpy arrays."""
    return [structs.field(structs.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _pair_places(ids: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Step from which the pair at each place is active; _NEVER for places across pieces and for rare words."""
    own = reach[ids]
    return np.maximum(own[:-1], own[1:])


def _local(row, size_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a chunk's words, and ids and reach by number."""
    ids = _unpacked(row["ids"].as_py())
    at, global_id, reach = _numbers(row["known"].values, "at", "id", "reach")
    size = size_of(ids)
    reach_of, id_of = np.full(size, _NEVER, np.int32), np.full(size, -1, np.int64)
    reach_of[at], id_of[at] = reach, global_id
    return ids, id_of, reach_of


def _size(ids: np.ndarray) -> int:
    return int(ids.max()) + 1


def _counts(batches, work, schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            columns = work({n: batch.column(n)[i] for n in batch.schema.names})
            if columns and len(columns[-1]):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pairs_at(chunks: DataFrame, step: int, shards: int) -> DataFrame:
    """Pairs that are active at a step, counted in each chunk of its shard."""
    schema = to_arrow_schema(StructType.fromDDL(PAIRS))

    def work(row):
        ids, id_of, reach = _local(row, _size)
        start = _pair_places(ids, reach)
        now = np.flatnonzero((start < step) & (start >= step - shards))
        size = len(id_of)
        codes, first, n = np.unique(ids[now].astype(np.int64) * size + ids[now + 1], return_index=True, return_counts=True)
        chunk, shard = (np.full(len(codes), row[k].as_py()) for k in ("chunk", "shard"))
        return [chunk, shard, id_of[codes // size], id_of[codes % size], start[now[first]] + 1, n]

    return chunks.where(F.col("shard") == step % shards).mapInArrow(lambda batches: _counts(batches, work, schema), PAIRS)


def triples_at(chunks: DataFrame, pairs: DataFrame, step: int, shards: int) -> DataFrame:
    """Triples that are active at a step, counted in each chunk of its shard; pairs tell the step at which each reached the threshold."""
    schema = to_arrow_schema(StructType.fromDDL(TRIPLES))
    mine = F.col("shard") == step % shards
    known = pairs.where(mine & (F.col("reach") < step)).groupBy("chunk").agg(F.collect_list(F.struct("a", "b", "reach")).alias("pairs"))

    def work(row):
        ids, id_of, _ = _local(row, _size)
        a, b, reach = _numbers(row["pairs"].values, "a", "b", "reach")
        size, order = len(id_of), np.argsort(id_of)
        number = order[np.searchsorted(id_of, np.concatenate([a, b]), sorter=order)]
        codes = number[: len(a)].astype(np.int64) * size + number[len(a):]
        order = np.argsort(codes)
        codes, reach = codes[order], reach[order]
        places = ids[:-1].astype(np.int64) * size + ids[1:]
        which = np.minimum(np.searchsorted(codes, places), len(codes) - 1)
        since = np.where(codes[which] == places, reach[which], _NEVER)
        start = np.maximum(since[:-1], since[1:])
        now = np.flatnonzero((start < step) & (start >= step - shards))
        found, n = np.unique(which[now] * size + ids[now + 2], return_counts=True)
        pair, last = codes[found // size], found % size
        return [id_of[pair // size], id_of[pair % size], id_of[last], n]

    rows = chunks.where(mine).join(known, "chunk").select("ids", "known", "pairs")
    return rows.mapInArrow(lambda batches: _counts(batches, work, schema), TRIPLES)


def _settled_pairs(live: DataFrame | None, new: DataFrame, step: int, least: int, shards: int) -> DataFrame:
    """Pairs in their chunks after a step, without those that ended their cycle below the threshold."""
    new = new.withColumn("reach", F.lit(None).cast("int"))
    rows = live.unionByName(new) if live is not None else new
    rows = rows.withColumn("_total", F.sum("n").over(Window.partitionBy("a", "b")))
    rows = rows.where((F.col("_total") >= least) | (F.col("start") + (shards - 1) > step))
    # the pair's earlier rows know when it reached the threshold, the new ones do not yet
    before = F.min("reach").over(Window.partitionBy("a", "b"))
    rows = rows.withColumn("reach", F.coalesce(before, F.when(F.col("_total") >= least, F.lit(step))))
    return staged(rows.drop("_total"), "pairs")


def counted(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", shards: int = SHARDS, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, f), pairs (a, b, f) and triples (a, b, c, f) with at least ``least`` occurrences, and words per language."""
    chunks = staged(coded(docs, text, lang, shards, size), "chunks")
    words, sizes, own = counted_words(chunks, least, shards)
    chunks = staged(with_words(chunks, own, words), "coded")
    live, triples = None, []
    # words reach the threshold by step shards - 1, so the last pairs end at 2 * shards - 1 and triples a cycle later
    for step in range(1, 3 * shards):
        if step < 2 * shards:
            before = live
            live = _settled_pairs(before, pairs_at(chunks, step, shards), step, least, shards)
        if step > 1:
            triples.append(triples_at(chunks, live, step, shards))
    pairs = staged(live.where("reach is not null").groupBy("a", "b").agg(F.sum("n").alias("f")), "pairs")
    rows = triples[0]
    for more in triples[1:]:
        rows = rows.unionByName(more)
    triples = staged(rows.groupBy("a", "b", "c").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "triples")
    return words.drop("reach"), pairs, triples, sizes


def _cut(l: Column, r: Column, at: int) -> Column:
    """Score of a cut after ``at`` words; all products stay below 38 digits for counts below 10 ** 15."""
    long = lambda c: c.cast("decimal(16,0)")
    a = long(F.col("a"))
    top, below = (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), long(l) * long(r)
    score = F.call_function("div", top.cast("decimal(38,0)"), below.cast("decimal(38,0)"))
    return F.struct(score.alias("score"), F.lit(at).alias("at"), l.alias("l"), r.alias("r"))


def collocations(docs: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", shards: int = SHARDS, size: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, count and phrase.

    Case of A-Z is ignored. Pieces end at ``.,;:!?`` and at line ends, words at spaces and tabs. A candidate of two or
    three words has at least ``least`` occurrences a within pieces; its score is that of the cut into a first part
    (l occurrences) and a rest (r) with the lowest floor(10**6 * a * a / (l * r)), the shortest first part of equals.
    A candidate inside a longer one with at least ``cover`` per cent of its occurrences is dropped. n counts all words
    of the language. A null text is empty, a null language is 'und'; texts without words, and empty tables, give no
    rows. Repeated rows count each time.
    """
    words, pairs, triples, sizes = counted(docs, least, text, lang, shards, size)

    def word(name: str) -> DataFrame:
        return words.select(F.col("id").alias(name), "lang" if name == "a" else F.lit(None).alias(f"_{name}"), F.col("word").alias(f"w{name}"), F.col("f").alias(f"f{name}"))

    covers = triples.select(F.explode(F.array(F.struct("a", "b", "f"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), "f"))).alias("e")).groupBy("e.a", "e.b").agg(F.max("e.f").alias("over"))
    two = pairs.join(covers, ["a", "b"], "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("f") * cover))
    two = two.join(word("a"), "a").join(word("b"), "b")
    two = two.select("lang", F.concat_ws(" ", "wa", "wb").alias("phrase"), F.col("f").alias("a"), "fa", "fb").select("lang", "phrase", "a", _cut(F.col("fa"), F.col("fb"), 1).alias("cut"))
    three = triples.join(pairs.withColumnRenamed("f", "fab"), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc")), ["b", "c"])
    three = three.join(word("a"), "a").join(word("b"), "b").join(word("c"), "c")
    three = three.select("lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("f").alias("a"), "fa", "fab", "fbc", "fc")
    three = three.select("lang", "phrase", "a", F.least(_cut(F.col("fa"), F.col("fbc"), 1), _cut(F.col("fab"), F.col("fc"), 2)).alias("cut"))
    order = F.col("cut.score").desc(), F.col("a").desc(), "phrase"
    # the first of each of some parts of a language, then of the language: one task sees top * PARTS rows of it at most
    found = two.unionByName(three).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
