"""Language identification by prediction by partial matching.

For every language, counts of bytes after contexts of up to three bytes become a tree of variable order: a
context that saw the byte gives its share, one that did not escapes (method C, with exclusion) to the
next shorter context. All contexts are kept. The statistics are frozen into sorted tables of the observed
sequences, with code lengths and escapes per language, so that a text is scored exactly: the sum of the code
lengths of all its bytes, per language, in whole-array steps.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from assay.llm.text import annotate, fresh_name, slices
from assay.session import staged

ORDER = 3
#: Bytes of text scored at once.
SHARD = 4 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]").search
COUNTS = "lang string, code long, n long"


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of texts with ORDER zero bytes before each; which belong to texts; first byte of each text."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    pad = bytes(ORDER)
    data = np.frombuffer(b"".join([x for t in raw for x in (pad, t)]), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + ORDER
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(data), bool)
    for k in range(ORDER):
        real[starts + k] = False
    return data, real, starts


def gathered(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, code, n): how often each sequence of ORDER + 1 bytes occurs per language, over all rows."""

    def count(batches):
        for batch in slices(batches, text, SHARD):
            langs = np.array(batch.column(lang).to_pylist(), object)
            texts = batch.column(text).to_pylist()
            for name in sorted(set(langs)):
                data, real, _ = _stream([texts[i] for i in np.flatnonzero(langs == name)])
                codes = np.zeros(max(0, len(data) - ORDER), np.uint32)
                for k in range(ORDER + 1):
                    codes = (codes << np.uint32(8)) | data[k : k + len(codes)]
                code, n = np.unique(codes[real[ORDER:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    rows = docs.select(lang, text).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return rows.mapInArrow(count, COUNTS).groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths of all sequences that any language has.

    codes[k]: sorted sequences of k + 1 bytes, bits[k]: [language, sequence] bits of the last byte after the others.
    contexts[k]: sorted contexts of k bytes, escapes[k]: [language, context] bits of leaving it for the next
    shorter one; 0 where the language does not have the context.
    """

    def __init__(self, langs: list[str], who: np.ndarray, code: np.ndarray, n: np.ndarray):
        """who, code, n: language, sequence of ORDER + 1 bytes and how often it occurs there."""
        self.langs = langs
        self.codes, self.bits, self.contexts, self.escapes = [], [], [], []
        # bytes that occur, the zero before texts, and one for any other byte
        size = len(np.union1d(code & 255, [0])) + 1
        who = who.astype(np.int64) << 32
        before = None
        for order in range(ORDER + 1):
            keys, at = np.unique(who | (code & ((1 << 8 * (order + 1)) - 1)), return_inverse=True)
            count = np.bincount(at, n, len(keys))
            lang, own = keys >> 32, keys & 0xFFFFFFFF
            _, start, group, kinds = np.unique((lang << 32) | (own >> 8), return_index=True, return_inverse=True, return_counts=True)
            mass = np.bincount(group, count, len(start)) + kinds
            if order == 0:
                free = (size - kinds).astype(float)
            else:  # share of the shorter context that the bytes of this one leave
                keys0, count0, group0, mass0 = before
                up = np.searchsorted(keys0, (lang << 32) | (own & ((1 << 8 * order) - 1)))
                parent = mass0[group0[up[start]]]
                free = (parent - np.bincount(group, count0[up], len(start))) / parent
            codes, contexts = np.unique(own), np.unique(own >> 8)
            escapes = np.zeros((len(langs), len(contexts)), np.float32)
            escapes[lang[start], np.searchsorted(contexts, own[start] >> 8)] = -np.log2(kinds / mass / free)
            bits = escapes[:, np.searchsorted(contexts, codes >> 8)]
            if order:
                bits += self.bits[-1][:, np.searchsorted(self.codes[-1], (codes & ((1 << 8 * order) - 1)).astype(np.uint32))]
            bits[lang, np.searchsorted(codes, own)] = -np.log2(count / mass[group])
            before = keys, count, group, mass
            self.codes.append(codes.astype(np.uint32))
            self.contexts.append(contexts.astype(np.uint32))
            self.bits.append(bits)
            self.escapes.append(escapes)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """[text, language] code lengths in bits."""
        out = np.zeros((len(texts), len(self.langs)))
        data, real, starts = _stream(texts)
        if not real.any():
            return out
        code = np.zeros(len(data) - ORDER, np.uint32)
        for k in range(ORDER + 1):
            code = (code << np.uint32(8)) | data[k : k + len(code)]
        code = code[real[ORDER:]]
        # per order: bytes found there and where; bytes that leave a context there and which
        steps, left = [], np.arange(len(code))
        for order in range(ORDER, -1, -1):
            own = code[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, hit = _found(self.codes[order], own)
            gone = left[~hit]
            where, known = _found(self.contexts[order], own[~hit] >> np.uint32(8))
            steps.append((order, left[hit], at[hit], gone[known], where[known]))
            left = gone
        n = np.diff(np.append(starts, len(data))) - ORDER
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]
        for lang in range(len(self.langs)):
            cost = np.zeros(len(code), np.float32)
            for order, found, at, gone, where in steps:
                cost[found] += self.bits[order][lang, at]
                cost[gone] += self.escapes[order][lang, where]
            out[some, lang] = np.add.reduceat(cost, first, dtype=np.float64)
        return out


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, values), len(table) - 1).astype(np.int32)
    return at, table[at] == values


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of the rows of docs with a text and a language; None if there are none."""
    counts = staged(gathered(docs, text, lang), "contexts")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    who = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    found = counts.select(who.cast("int").alias("who"), "code", "n").toArrow()
    return Model(langs, *(found.column(c).to_numpy() for c in ("who", "code", "n")))


def identified(docs: DataFrame, model: Model | None, text: str = "text", name: str = "language") -> tuple[DataFrame, str]:
    """docs with a struct column of lang_pred and score (share of the best language); and its name.

    Null texts and texts without a letter give 'und' and 0; so does a model of no language. Equal code
    lengths take the first language by name. Rows, repeated or not, are annotated in place.
    """
    name = fresh_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = StructType([StructField("lang_pred", StringType(), False), StructField("score", DoubleType(), False)])

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch):
            texts = batch.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if t and own and LETTER(t)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                bits = own.lengths([texts[i] for i in known])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                for i, b, s in zip(known, best.tolist(), share.tolist()):
                    langs[i], scores[i] = own.langs[b], s
            return [langs, scores]
        return work

    return annotate(docs, name, fields, make, text, SHARD), name


def in_fold(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text falls into a fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
