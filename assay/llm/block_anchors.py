"""Substring dedup by fixed-block anchors.

Each document indexes its non-overlapping blocks of BLOCK words and probes with every rolling window of as many
words. A repeat of WINDOW = 2 * BLOCK - 1 words or more holds a whole block of either document, so each
repeat is hit. Hits name all windows around them; windows with equal hashes (80 to 96 bits, not compared word
for word) merge into the maximal repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from assay.llm.repeats import Anchors, Chunk, removed

WINDOW = 13


class Blocks(Anchors):
    def __init__(self, window: int = WINDOW):
        self.window, self.words = window, (window + 1) // 2

    def propose(self, chunk: Chunk):
        long = np.repeat(chunk.sizes >= self.window, chunk.sizes)
        at = np.flatnonzero((chunk.left >= self.words) & long)
        offset = at - np.repeat(chunk.starts, chunk.sizes)[at]
        return at, offset % self.words == 0, None

    def candidates(self, chunk: Chunk, at, shared, more):
        hit = np.zeros(len(chunk.words) + self.window + 1, np.int32)
        hit[at[shared] + 1] = 1
        before = np.cumsum(hit)
        start = np.flatnonzero(chunk.left >= self.window)
        return start[before[start + self.window - self.words + 1] > before[start]]


def without_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs without the words of windows that also start in a document with a smaller id; see repeats.removed."""
    return removed(docs, Blocks(window), **options)
