"""Token counts of a piece vocabulary with merges, by counting whole pre-tokens.

A pre-token is a run of spaces with the characters up to the next space, or a line feed. No piece of
the vocabulary spans two pre-tokens (checked when it is loaded), so counts add up. Every piece is
encoded alone once, offline: those that come out as one token count 1 wherever they are a pre-token,
and only the other pre-tokens are merged.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from assay.llm.text import annotate, fresh_name

SPACE = "▁"
#: Pre-tokens longer than this, and counts beyond the next number, are not remembered.
CACHED_LENGTH = 48
CACHED = 500_000


def load_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Scores of the ordinary pieces of a sentencepiece model, and whether unknown characters become bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    size = model.get_piece_size()
    return {model.id_to_piece(i): model.get_score(i) for i in range(size) if not special(i)}, any(model.is_byte(i) for i in range(size))


class Counter:
    """Counts tokens of texts; scores are those of load_pieces."""

    def __init__(self, scores: dict[str, float], bytes_for_unknown: bool):
        self.scores, self.to_bytes = scores, bytes_for_unknown
        ranks = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.order, self.none = {p: ranks[s] for p, s in scores.items()}, len(ranks)
        joined = [p for p in scores if re.search(f"[^{SPACE}]{SPACE}", p)]
        lines = [p for p in scores if "\n" in p]
        if joined or lines:
            raise ValueError("pieces of this vocabulary span pre-tokens")
        # "word" also stands for the word after a line feed, " word" for one after a space
        self.alone = {p.replace(SPACE, " "): 1 for p in scores if self.merged(p) == 1}
        merged, alone = self.merged, self.alone

        class Known(dict):
            def __missing__(self, piece):
                n = alone.get(piece) or merged(piece.replace(" ", SPACE))
                if len(piece) <= CACHED_LENGTH:
                    if len(self) >= CACHED:
                        self.clear()
                    self[piece] = n
                return n

        self.known = Known()
        self.pieces = re.compile(r" *[^ \n]+|\n| +").findall

    def cost(self, symbol: str) -> int:
        return 1 if symbol in self.scores else len(symbol.encode()) if self.to_bytes else 1

    def merged(self, piece: str) -> int:
        """Tokens after merging the best-scored neighbours first, the leftmost of equals."""
        parts = list(piece)
        if len(parts) > 64:
            return self.merged_long(parts)
        get, none = self.order.get, self.none
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        n = len(parts)
        for p in parts:
            if p not in self.order:
                n += self.cost(p) - 1
        return n

    def merged_long(self, parts: list[str]) -> int:
        """The same with a heap and links, for long pre-tokens."""
        scores, n = self.scores, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i):
            j = after[i]
            if j < n and (s := scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return sum(self.cost(p) for p in parts if p)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.known.__getitem__, self.pieces(" " + text.replace(SPACE, " "))))


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", name: str = "counted") -> tuple[DataFrame, str]:
    """docs with a struct column of n_bytes, n_tokens and over_limit (more than limit tokens); and its name.

    The vocabulary is read on the driver and broadcast; its size is fixed by the file. Null and empty
    texts have no bytes and no tokens. Rows, repeated or not, are annotated in place.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    name = fresh_name(docs, name)
    fields = StructType([StructField("n_bytes", LongType(), False), StructField("n_tokens", LongType(), False), StructField("over_limit", BooleanType(), False)])
    held: list[Counter] = []

    def make():
        if not held:
            held.append(Counter(*pieces.value))
        own = held[0]

        def work(batch: pa.RecordBatch):
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())
            n = [own.count(t) for t in batch.column(text).to_pylist()]
            return [sizes, n, [x > limit for x in n]]
        return work

    return annotate(docs, name, fields, make, text), name


def counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    counted, name = token_counts(docs.select("doc_id", "text"), path, limit)
    return counted.select("doc_id", F.col(f"{name}.*"))
