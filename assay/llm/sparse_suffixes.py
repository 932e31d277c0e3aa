"""Substring dedup by window hashes at sparse suffixes.

Only places of minimisers are kept: of all ANCHOR-word sequences in a window of WINDOW words the
one with the smallest hash. Equal windows choose equal minimisers, so each repeat of WINDOW words keeps a
common place in both. Hashes of the ANCHOR words there are matched in buckets, and windows that chose a shared
minimiser are compared by hash; no suffixes are sorted and no match is extended word by word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from assay.llm.repeats import Anchors, Chunk, removed

WINDOW = 50
ANCHOR = 8


class Minimisers(Anchors):
    def __init__(self, window: int = WINDOW, words: int = ANCHOR):
        self.window, self.words = window, words

    def _chosen(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(starts of whole windows, position of the minimiser of each; the leftmost of equals)."""
        start = np.flatnonzero(chunk.left >= self.window)
        if not len(start):
            return start, start
        rank = chunk.hashes(self.words, 1)
        bits = len(rank).bit_length()
        least = (rank >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(rank), dtype=np.uint64)
        span, width = self.window - self.words + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        return start, (least[start] & np.uint64((1 << bits) - 1)).astype(np.int64)

    def propose(self, chunk: Chunk):
        start, chosen = self._chosen(chunk)
        at = np.unique(chosen)
        return at, np.ones(len(at), bool), (start, chosen)

    def candidates(self, chunk: Chunk, at, shared, more):
        start, chosen = more
        return start[shared[np.searchsorted(at, chosen)]]


def without_repeats(docs: DataFrame, window: int = WINDOW, words: int = ANCHOR, **options) -> DataFrame:
    """docs without the words of windows that also start in a document with a smaller id; see repeats.removed."""
    return removed(docs, Minimisers(window, words), **options)
