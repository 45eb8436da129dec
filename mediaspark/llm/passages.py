"""Anchors of word sequences: what substring dedup and sparse suffix arrays share.

Of every `window` words the smallest hash among its runs of `width` words is the window's anchor. Equal windows
have equal anchors wherever they stand, and about 2 / (window - width + 2) of the positions are anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mediaspark.llm.common import gram_hashes, text_buffer, word_hashes, words


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n values in a row, by doubling."""
    if len(h) < n:
        return h[:0]
    have, size = h, 1
    while 2 * size <= n:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[:len(h) - n + 1], have[n - size:]) if n > size else have


class Words:
    """The words of a slice of texts, one after another."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = text_buffer(texts)
        self.starts, self.ends, self.doc = words(self.data, self.off)
        self.n = len(self.off) - 1
        self.hash = word_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))

    def inside(self, size: int) -> np.ndarray:
        """Whether the so many words from each place on are of one text."""
        count = max(0, len(self.doc) - size + 1)
        return self.doc[:count] == self.doc[size - 1:] if count else np.zeros(0, bool)

    def grams(self, width: int) -> np.ndarray:
        return gram_hashes(self.hash, width, 40 + width)

    def anchors(self, width: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of width words, and the anchor of each window."""
        h = self.grams(width)
        return h, sliding_min(h, window - width + 1)
