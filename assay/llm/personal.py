"""Personal data: four patterns, and a conditional random field that finds more like them.

The patterns decide the base spans. A field over the shapes of words learns from them in a small table of
labelled stretches of text, and adds the spans that it reads as personal data where no pattern matches. It looks
at every word near a digit or an at sign; a word farther than REACH words from any is tagged as nothing, and
ends the stretch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assay.llm.shape_crf import Field
from assay.llm.text import annotate, bound_batches, fresh_name, slices, utf8

KINDS = ["email", "ip", "card", "phone"]
OTHER = len(KINDS)
#: Stretches that the field learns from, at most: those with the smallest hash, half of them with a base span; and words of each.
LABELLED, LONGEST = 4096, 32
#: Words on both sides of a word with a digit or an at sign that belong to its stretch.
REACH = 2

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in "._%+-")
# a match that begins at the first digit of a run fails from every later digit of it too
_IP = re.compile(rb"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").finditer
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_CARD_SIZES, _PHONE_SIZES = range(16, 20), range(8, 16)


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """From one at sign to the next: the run before it that may belong to a name, then the domain after it."""
    low, at = 0, text.find(b"@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        domain = _DOMAIN(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find(b"@", low)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and start."""
    out = [(0, *s) for s in emails(text)]
    for m in _IP(text):
        if all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD(text):
        if m.end() - m.start() >= _CARD_SIZES.start:
            digits = m.group().translate(None, b" -")
            if len(digits) in _CARD_SIZES and luhn(digits):
                out.append((2, *m.span()))
    for m in _PHONE(text):
        if len(m.group().translate(None, _DIGITS)) in _PHONE_SIZES:
            out.append((3, *m.span()))
    return out


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*range(48, 58), 64]] = True


def stretches(text: bytes, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words near a digit or an at sign, and which of them begin a stretch."""
    data = np.frombuffer(text, np.uint8)
    marks = np.flatnonzero(_IS_MARK[data])
    none = np.zeros(0, np.int64)
    if not len(marks):
        return none, none, np.zeros(0, bool)
    white = np.concatenate([[True], _IS_WHITE[data], [True]])
    starts = np.flatnonzero(white[:-1] & ~white[1:])
    ends = np.flatnonzero(~white[:-1] & white[1:])
    holding = np.unique(np.searchsorted(starts, marks, "right") - 1)
    near = np.zeros(len(starts) + 2 * reach + 1, np.int64)
    np.add.at(near, holding, 1)
    np.add.at(near, holding + 2 * reach + 1, -1)
    words = np.flatnonzero(np.cumsum(near)[reach : reach + len(starts)] > 0)
    first = np.ones(len(words), bool)
    first[1:] = np.diff(words) > 1
    return starts[words], ends[words], first


def _tags(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Kind of each word: that of the first base span by kind that overlaps it."""
    tags = np.full(len(starts), OTHER, np.int64)
    for kind, a, b in reversed(spans):
        low, high = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        tags[low:high] = kind
    return tags


def labelled(docs: DataFrame, text: str = "text", limit: int = LABELLED) -> DataFrame:
    """(h, some, words, tags): stretches of text tagged by the patterns, at most ``limit``, different ones.

    Half of them hold a base span. A task sends only its own smallest hashes, so copies of a stretch count once.
    """
    bound_batches(docs.sparkSession)
    half = limit // 2
    schema = "h long, some boolean, words array<binary>, tags array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, dict[int, tuple]] = {True: {}, False: {}}
        for batch in slices(batches, text):
            for value in utf8(batch, text):
                if not value:
                    continue
                starts, ends, first = stretches(value)
                if not len(starts):
                    continue
                tags = _tags(starts, ends, base_spans(value))
                edges = [*np.flatnonzero(first).tolist(), len(starts)]
                for a, b in zip(edges, edges[1:]):
                    for i in range(a, b, LONGEST):
                        j = min(i + LONGEST, b)
                        words = [value[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())]
                        own = tags[i:j].tolist()
                        h = xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)
                        held[min(own) < OTHER][h] = (words, own)
            for some, known in held.items():
                if len(known) > 4 * half:
                    held[some] = {h: known[h] for h in sorted(known)[:half]}
        rows = [{"h": h, "some": some, "words": known[h][0], "tags": known[h][1]} for some, known in held.items() for h in sorted(known)[:half]]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("h", pa.int64()), ("some", pa.bool_()), ("words", pa.list_(pa.binary())), ("tags", pa.list_(pa.int32()))]))

    rows = docs.select(text).mapInArrow(run, schema).dropDuplicates(["some", "h"])
    return rows.where("some").orderBy("h").limit(half).unionByName(rows.where("not some").orderBy("h").limit(half))


def fit(docs: DataFrame, text: str = "text", limit: int = LABELLED) -> Field | None:
    """The field learned from the labelled stretches of docs; None if they hold no base span."""
    table = labelled(docs, text, limit).toArrow().to_pylist()
    table.sort(key=lambda r: (not r["some"], r["h"]))
    if not any(r["some"] for r in table):
        return None
    table += [short for r in table if (short := without_leads(r["words"], r["tags"]))]
    sentences = [r["words"] for r in table]
    field = Field(OTHER + 1, sentences)
    field.fit(sentences, [r["tags"] for r in table])
    return field


def without_leads(words: list[bytes], tags: list[int]) -> dict | None:
    """The stretch without the first word of each span of several words, which is what the patterns hold on to."""
    n = len(words)
    lead = [tags[i] != OTHER and i + 1 < n and tags[i + 1] == tags[i] and (i == 0 or tags[i - 1] != tags[i]) for i in range(n)]
    if not any(lead):
        return None
    return {"words": [w for w, gone in zip(words, lead) if not gone], "tags": [t for t, gone in zip(tags, lead) if not gone]}


_ENDS = b" \t\n\x0b\x0c\r.,;:!?'\"<>[]{}|/\\*#$&%=_-~`^"


def credible(kind: int, span: bytes) -> bool:
    """Whether an added span passes what its kind can be tested for, whatever stands between its digits."""
    digits = span.translate(None, _DIGITS)
    if kind == 0:
        return b"@" in span.strip(b"@")
    if kind == 1:
        parts = [p.lstrip(b"0") for p in re.findall(rb"[0-9]+", span)]
        return len(parts) == 4 and all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts)
    if kind == 2:
        return len(digits) in _CARD_SIZES and luhn(digits)
    return len(digits) in _PHONE_SIZES


def added_spans(text: bytes, base: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray, first: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of words of one kind that touch no base span, without punctuation at their ends, where credible."""
    covered = _tags(starts, ends, base) != OTHER
    use = np.flatnonzero((tags != OTHER) & ~covered)
    out = []
    if not len(use):
        return out
    cuts = np.flatnonzero((np.diff(use) > 1) | first[use[1:]] | (tags[use[1:]] != tags[use[:-1]])) + 1
    for run in np.split(use, cuts):
        kind, a, b = int(tags[run[0]]), int(starts[run[0]]), int(ends[run[-1]])
        span = text[a:b]
        a += len(span) - len(span.lstrip(_ENDS))
        b -= len(span) - len(span.rstrip(_ENDS))
        if credible(kind, text[a:b]):
            out.append((kind, a, b))
    return out


def _named(spans: list[tuple[int, int, int]], points: np.ndarray | None) -> str:
    place = (lambda i: i) if points is None else (lambda i: int(points[i]))
    return ",".join(f"{KINDS[k]}:{place(a)}:{place(b)}" for k, a, b in spans)


def found(docs: DataFrame, field: Field | None, text: str = "text", name: str = "personal") -> tuple[DataFrame, str]:
    """docs with a struct column of base spans per kind, the digest of base spans, and all spans; and its name.

    Spans are kind:start:end in code points, end exclusive, by kind and start. Null and empty texts have none.
    Rows, repeated or not, are annotated in place. Without a field there are base spans only.
    """
    name = fresh_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    fields = StructType([*(StructField(f"n_{k}", LongType(), False) for k in KINDS), StructField("base_sha256", StringType(), False), StructField("spans", StringType(), False)])

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch):
            texts = utf8(batch, text)
            base = [base_spans(t) if t else [] for t in texts]
            more: dict[int, list] = {}
            near = [(i, *s) for i, t in enumerate(texts) if t and own is not None and len((s := stretches(t))[0])]
            if near:
                words = [texts[i][a:b] for i, starts, ends, _ in near for a, b in zip(starts.tolist(), ends.tolist())]
                first = np.concatenate([f for *_, f in near])
                begin = np.flatnonzero(first)
                tags = own.viterbi(own.scores(own.numbers(words), first), np.diff(np.append(begin, len(first))))
                at = 0
                for i, starts, ends, own_first in near:
                    more[i] = added_spans(texts[i], base[i], starts, ends, own_first, tags[at : at + len(starts)])
                    at += len(starts)
            digests, spans = [], []
            for i, (t, known) in enumerate(zip(texts, base)):
                every = sorted([*known, *more.get(i, [])])
                points = None
                if every and not t.isascii():
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                digests.append(hashlib.sha256(_named(known, points).encode()).hexdigest())
                spans.append(_named(every, points))
            counts = [[sum(s[0] == k for s in known) for known in base] for k in range(len(KINDS))]
            return [*counts, digests, spans]
        return work

    return annotate(docs, name, fields, make, text), name


def personal(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    marked, name = found(docs, fit(docs))
    return marked.select("doc_id", F.col(f"{name}.*"))
