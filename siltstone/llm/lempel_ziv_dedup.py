"""Repeated passages by relative Lempel-Ziv parsing.

Each bucket of stretches (see ``repeats``) is an indexed reference block, and every document is factored
against each block it has an anchor with: the others can't hold a passage of it. Parsing is greedy: a
factor is the longest beginning of what is left that some other document of the block has, and the
next factor starts where it ends; matches are looked up at the starts of factors only. A factor of
``LEAST`` words or more is a duplicate span.

A passage of ``LEAST`` words that no factor holds crosses just one factor boundary, for from a boundary
within it a match reaches to its end, and the factor there at least as far. So boundaries are checked
where the factors on both sides have ``LEAST`` words together, and there only the starts from which a
passage can end within the right factor.

A match is looked up in the block's suffix array: the nearest rows above and below that belong to
another document, and the words in common with them.

The result has, for each document, the maximal stretches of words made of such spans.

Defined results
* texts that are null, empty or shorter than ``LEAST`` words have no passage, and a null doc_id none.
* a document is never its own reference, but with ``anywhere`` its other places are; rows of one doc_id are
  one document, and the same word of them is one place.
* every document that has a passage is named, the first one as well: ties don't matter.
* an empty table gives no rows; further columns are ignored; very long texts are searched whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from siltstone.llm.repeats import LEAST, SQL, Block, Prefixes, covered, owners, repeated_spans, suffix_array

__all__ = ["SQL", "Reference", "duplicates", "factors", "find"]

#: More words than a stretch can have, so that all suffixes are told apart.
DEPTH = 128


class Reference:
    """An indexed block: its suffixes in order, and for each row the nearest ones of other documents (or places)."""

    def __init__(self, block: Block, anywhere: bool = False):
        self.order, self.rank = suffix_array(block.symbols, DEPTH)
        owner = owners(block, anywhere)[self.order]
        n = len(owner)
        change = np.flatnonzero(owner[1:] != owner[:-1]).astype(np.int32) + 1
        begin, end = np.zeros(n, dtype=np.int32), np.full(n, n, dtype=np.int32)
        begin[change], end[change - 1] = change, change
        self.above = np.maximum.accumulate(begin) - 1
        self.below = np.minimum.accumulate(end[::-1])[::-1]
        self.prefixes = Prefixes(block.symbols, DEPTH // 2)
        self.lookups = 0

    def longest(self, at: np.ndarray) -> np.ndarray:
        """How many words from each of the places on some other document has."""
        self.lookups += len(at)
        best = np.zeros(len(at), dtype=np.int64)
        for near in (self.above[self.rank[at]], self.below[self.rank[at]]):
            some = np.flatnonzero((near >= 0) & (near < len(self.order)))
            best[some] = np.maximum(best[some], self.prefixes.common(at[some], self.order[near[some]]))
        return best


def factors(block: Block, reference: Reference) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all factors, in order, and their lengths; a word without a match is a factor by itself."""
    at = np.flatnonzero(np.concatenate([[True], block.stretch[1:] != block.stretch[:-1]]))
    last = np.append(at[1:], len(block.stretch)) - 1
    starts, lengths = [], []
    while len(at):
        n = np.maximum(reference.longest(at), 1)
        starts.append(at)
        lengths.append(n)
        at = at + n
        more = at < last
        at, last = at[more], last[more]
    start, length = np.concatenate(starts), np.concatenate(lengths)
    order = np.argsort(start)
    return start[order], length[order]


def find(block: Block, anywhere: bool = False) -> np.ndarray:
    if len(block.docs) < (1 if anywhere else 2):
        return np.zeros((0, 3), dtype=np.int64)
    reference = Reference(block, anywhere)
    start, length = factors(block, reference)
    long = length >= LEAST
    # starts of passages that cross the boundary before a factor, in the factor before it
    left, right = start[:-1], start[1:]
    both = (block.stretch[left] == block.stretch[right]) & (length[:-1] + length[1:] >= LEAST)
    low = np.maximum(left, right - LEAST + 1)[both]
    high = np.minimum(right - 1, right + length[1:] - LEAST)[both]
    size = np.maximum(high - low + 1, 0)
    near = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    reach = reference.longest(near)
    near, reach = near[reach >= LEAST], reach[reach >= LEAST]
    at, size = np.concatenate([start[long], near]), np.concatenate([length[long], reach])
    return covered(block.doc[at], block.word[at], block.word[at] + size)


def duplicates(docs: DataFrame, anywhere: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of the passages that other documents have too, or other places."""
    return repeated_spans(docs, find, anywhere)
