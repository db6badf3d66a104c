"""Hierarchical packing of documents into context windows of several lengths.

A document goes to the shortest tier that holds it; one longer than the longest tier is cut into
pieces of that length and a rest. From the longest tier to the shortest, pieces are packed by best
fit, the longest first; what then is free in the tier's windows is filled with the longest pieces
of shorter tiers that fit. The windows of a tier are dealt to step groups of equal capacity, the
fullest first and in turn forwards and backwards, so that groups hold about as many tokens.

Documents are packed in shards of about ``SHARD`` documents each, whatever the size of the corpus. They
are dealt to shards in turn, so that shards are even whatever their ids; a shard is a task of its own.
Only identifiers and lengths are shuffled, never texts.

Tokens are counted as a quarter of the UTF-8 bytes, rounded up, or by ``counter``, a column of
lengths that a tokenizer made.

Defined results
* a null or empty text has no tokens and gets no row.
* every token of every other row is in exactly one piece, however long the text is.
* ties of length are packed in the order of doc_id, null first; repeated rows are packed each.
* an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import only

TIERS = (512, 2048, 8192)
STEP_TOKENS = 65536
SHARD = 50_000
SCHEMA = "shard bigint, tier bigint, window_no bigint, step bigint, offset bigint, doc_id bigint, piece bigint, start bigint, n_tokens bigint"


class Gaps:
    """A multiset of numbers up to a limit, each with a stack of values; finds the next number in O(limit / word)."""

    def __init__(self, limit: int):
        self.bits, self.stacks = 0, [[] for _ in range(limit + 1)]

    def add(self, number: int, value) -> None:
        self.stacks[number].append(value)
        self.bits |= 1 << number

    def take(self, number: int):
        value = self.stacks[number].pop()
        if not self.stacks[number]:
            self.bits &= ~(1 << number)
        return value

    def at_least(self, number: int) -> int | None:
        above = self.bits >> number
        return number + (above & -above).bit_length() - 1 if above else None

    def at_most(self, number: int) -> int | None:
        below = self.bits & ((1 << (number + 1)) - 1)
        return below.bit_length() - 1 if below else None


def pack(lengths: list[tuple[int | None, int]], tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> list[tuple]:
    """(tier, window, step, offset, doc_id, piece, start, n) of the documents (doc_id, tokens)."""
    top = tiers[-1]
    pieces: dict[int, list[tuple]] = {t: [] for t in tiers}
    for doc, total in lengths:
        for k, start in enumerate(range(0, total, top)):
            n = min(top, total - start)
            pieces[next(t for t in tiers if t >= n)].append((n, doc, k, start))
    order = {t: sorted(p, key=lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2], x[3])) for t, p in pieces.items()}
    # the shorter pieces wait in stacks by length, the first of each length on top
    waiting = Gaps(top)
    for t in tiers:
        for p in reversed(order[t]):
            waiting.add(p[0], p)
    rows = []
    for tier in reversed(tiers):
        low = tiers[tiers.index(tier) - 1] if tier != tiers[0] else 0
        windows: list[list[tuple]] = []
        gaps = Gaps(tier)
        while (n := waiting.at_most(tier)) is not None and n > low:
            piece = waiting.take(n)
            gap = gaps.at_least(n)
            if gap is None:
                windows.append([piece])
                gaps.add(tier - n, len(windows) - 1)
            else:
                w = gaps.take(gap)
                windows[w].append(piece)
                gaps.add(gap - n, w)
        left = [tier - sum(p[0] for p in w) for w in windows]
        for w in sorted(range(len(windows)), key=lambda w: (-left[w], w)):
            while (n := waiting.at_most(left[w])) is not None:
                windows[w].append(waiting.take(n))
                left[w] -= n
        steps = max(1, math.ceil(len(windows) * tier / step_tokens))
        for turn, w in enumerate(sorted(range(len(windows)), key=lambda w: (left[w], w))):
            lap, place = divmod(turn, steps)
            offset = 0
            for n, doc, k, start in windows[w]:
                rows.append((tier, w, place if lap % 2 == 0 else steps - 1 - place, offset, doc, k, start, n))
                offset += n
    return rows


def packed(docs: DataFrame, counter: Column | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, shard: int = SHARD) -> DataFrame:
    """A row for each piece of a document: the window and step group it lies in, and where."""
    n = F.ceil(F.octet_length(docs["text"]) / 4) if counter is None else counter
    lengths = docs.select(docs["doc_id"], n.cast("bigint").alias("n")).filter("n > 0")
    shards = max(1, math.ceil(only(docs, "doc_id").count() / shard))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(d, k) for batch in batches for d, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        rows = pack(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), tiers, step_tokens)
        number = TaskContext.get().partitionId()
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        yield pa.record_batch([pa.array([number] * len(rows), pa.int64()), *(pa.array(list(c), pa.int64()) for c in columns)], names=names)

    return lengths.repartition(shards).mapInArrow(run, SCHEMA)
