"""Repeated passages by a run-compressed index.

The stretches of a bucket (see ``repeats``) are a repetitive text by construction. Its Burrows-Wheeler
transform is kept as runs only: for each run the suffix at its head, the suffix at the end of the run
above, and how many words those two share. The suffix array is dropped once the runs are known. That is
enough to stream matching statistics over the text: the row above that of a place, and the words
shared with it, follow from the nearest run head at or before the place, one word further and one
word less with every step. Places whose matches reach ``LEAST`` words are chained to the place one
row above; a chain is a group of windows that are equal, and where a group has two documents, its
windows are repeated passages.

The index is made for each bucket, not for the whole corpus at once: equal windows share a bucket.

The result has, for each document, the maximal stretches of words made of windows of ``LEAST`` words
that another document has too.

Defined results
* texts that are null, empty or shorter than ``LEAST`` words have no passage, and a null doc_id none.
* a passage that only repeats within one document isn't one, but with ``anywhere`` it is; rows of one doc_id
  are one document, and the same word of them is one place.
* every document that has a passage is named, the first one as well: ties don't matter.
* an empty table gives no rows; further columns are ignored; very long texts are searched whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from siltstone.llm.repeats import LEAST, SQL, Block, Prefixes, covered, owners, repeated_spans, suffix_array

__all__ = ["SQL", "RunLengthIndex", "duplicates", "find"]

#: More words than a stretch can have, so that all suffixes are told apart.
DEPTH = 128


class RunLengthIndex:
    """Samples at the runs of the Burrows-Wheeler transform, in the order of the text.

    ``heads`` are the suffixes at the heads of runs, ``above`` those at the ends of the runs before, and
    ``shared`` the words that both have in common.
    """

    __slots__ = ("heads", "above", "shared", "n")

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        order, _ = suffix_array(symbols, DEPTH)
        bwt = symbols[order - 1]
        # separators, the numbers up to the last one, are all different, so each is a run of its own
        rows = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] <= symbols[-1])) + 1
        heads, above = order[rows], order[rows - 1]
        first = order[0]
        del order, bwt
        shared = Prefixes(symbols, DEPTH // 2).common(heads, above).astype(np.int32)
        # the first row has none above
        heads, above, shared = np.append(heads, first), np.append(above, first), np.append(shared, np.int32(0))
        by_place = np.argsort(heads)
        self.heads, self.above, self.shared = heads[by_place], above[by_place], shared[by_place]

    @property
    def nbytes(self) -> int:
        return self.heads.nbytes + self.above.nbytes + self.shared.nbytes

    def statistics(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For the places from ``begin`` to ``end``: the place one row above, and how many words are shared with it."""
        place = np.arange(begin, end)
        run = np.searchsorted(self.heads, place, "right") - 1
        run = np.maximum(run, 0)
        past = place - self.heads[run]
        shared = np.where(past >= 0, self.shared[run] - past, 0)
        return np.where(shared > 0, self.above[run] + past, place), np.maximum(shared, 0)


def find(block: Block, anywhere: bool = False, step: int = 1 << 16) -> np.ndarray:
    if len(block.docs) < (1 if anywhere else 2):
        return np.zeros((0, 3), dtype=np.int64)
    index = RunLengthIndex(block.symbols)
    chain = np.arange(index.n, dtype=np.int32)
    for begin in range(0, index.n, step):
        above, shared = index.statistics(begin, min(begin + step, index.n))
        long = np.flatnonzero(shared >= LEAST)
        chain[begin + long] = above[long]
    del index
    linked = np.flatnonzero(chain != np.arange(len(chain), dtype=np.int32))
    if not len(linked):
        return np.zeros((0, 3), dtype=np.int64)
    root = chain[linked]
    while True:  # twice as far along the chain in each turn
        chain[linked] = chain[root]
        if (chain[linked] == root).all():
            break
        root = chain[linked]
    places, group = np.concatenate([linked, np.unique(root)]), np.concatenate([root, np.unique(root)])
    order = np.argsort(group, kind="stable")
    places, group = places[order], group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    owner = owners(block, anywhere)[places]
    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    at = places[np.repeat(low < high, np.diff(np.append(first, len(group))))]
    return covered(block.doc[at], block.word[at], block.word[at] + LEAST)


def duplicates(docs: DataFrame, anywhere: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of the passages that other documents have too, or other places."""
    return repeated_spans(docs, find, anywhere)
