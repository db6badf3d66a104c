"""Benchmark decontamination by spaced seeds.

A seed is a mask over ``WINDOW`` consecutive words that ignores some of them. Training words are
hashed under each mask and met with the hashes of the benchmark items; around each hit the words of
both sides are compared on the same diagonal. A document overlaps an item where ``WINDOW`` words in
a row agree in all but ``SUBSTITUTIONS`` places. The masks are lossless: whichever two of the fifteen
words are substituted, one mask at some place meets none of them, so no overlap is missed.

Words are lower-cased runs without ASCII punctuation.

Defined results
* a null or empty text, or an item without words, overlaps nothing.
* an item shorter than ``WINDOW`` must agree as a whole and without substitution; one of fewer than
  ``PHRASE`` words is a common phrase within other texts, and is met by a document that has no other words.
* repeated benchmark rows count once; each row of a repeated document has its own result rows.
* a null doc_id or item_id is carried along as null; the stage judges rows by their text, with or without one.
* an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import U64, Words, chunks, cut, fresh, loose, mix, normal, only, powers, words_of

WINDOW, SUBSTITUTIONS, PHRASE = 15, 2, 5
MASKS = ((0, 1, 3, 4, 5, 6, 7, 9), (0, 1, 2, 3, 4, 8, 9, 10), (0, 1, 2, 6, 7, 9, 10, 12))
#: Benchmarks of more text than this are joined by a shuffle instead of being sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Bits of the filter that keeps training seeds which no item has out of that shuffle, and bytes in a part of it.
FILTER_BITS, FILTER_PART = 1 << 27, 1 << 16
SCHEMA = "doc_id bigint, item_id bigint, n_tokens bigint"


def masked(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the words that ``mask`` keeps, from each position on at which it fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=U64)
    up, _ = powers(64)
    total = np.full(n, len(mask), dtype=U64)
    for i, at in enumerate(mask):
        total += hashes[at : at + n] * up[i + 1]
    return mix(total)


def masks_for(lengths: set[int]) -> list[tuple[int, ...]]:
    """The spaced masks, and a full one for each length below ``WINDOW`` that an item has."""
    short = [tuple(range(n)) for n in sorted(lengths) if 0 < n < WINDOW]
    return [*(MASKS if any(n >= WINDOW for n in lengths) else ()), *short]


def positions(words: Words, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position in all words, and hash of each place of a mask that stays within one text; a phrase must be all of it."""
    found = masked(words.hashes, mask)
    lengths = np.diff(words.first)
    if len(mask) < PHRASE:
        text = np.flatnonzero(lengths == len(mask))
        return text, words.first[text], found[words.first[text]]
    text = np.repeat(np.arange(len(words.first) - 1), lengths)[: len(found)]
    inside = np.flatnonzero(np.arange(len(found)) + mask[-1] < words.first[text + 1]) if len(found) else np.zeros(0, dtype=np.int64)
    return text[inside], inside, found[inside]


def overlap(doc: np.ndarray, item: np.ndarray, diagonals: set[int]) -> int:
    """How many words of ``item`` lie in overlapping windows on the diagonals (doc - item position)."""
    n = len(item)
    window = min(WINDOW, n)
    need = window - SUBSTITUTIONS if n >= WINDOW else window
    covered = np.zeros(n + 1, dtype=np.int64)
    for diagonal in diagonals:
        low, high = max(0, -diagonal), min(n, len(doc) - diagonal)
        if high - low < window:
            continue
        same = np.concatenate([[0], np.cumsum(doc[low + diagonal : high + diagonal] == item[low:high])])
        at = np.flatnonzero(same[window:] - same[:-window] >= need) + low
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


class Probe:
    """The benchmark's hashes under each mask, to be met by those of training texts."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        rows = sorted(set(zip(ids, map(normal, texts), strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [i for i, _ in rows]
        words = words_of([t for _, t in rows]) if rows else None
        self.items = [words.hashes[words.first[k] : words.first[k + 1]] for k in range(len(rows))]
        lengths = np.array([len(x) for x in self.items], dtype=np.int64)
        self.tables = []
        for mask in masks_for(set(lengths.tolist())):
            item, at, found = positions(words, mask)
            fits = lengths[item] >= WINDOW if mask in MASKS else lengths[item] == len(mask)
            item, at, found = item[fits], at[fits] - words.first[item[fits]], found[fits]
            order = np.argsort(found, kind="stable")
            bits = np.zeros(1 << 22, dtype=bool)
            bits[(found >> U64(42)).astype(np.int64)] = True
            self.tables.append((mask, found[order], item[order], at[order], bits))

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[int]]]:
        """(text, item, diagonals) wherever a text and an item share a seed."""
        met = []
        for mask, table, item, at, bits in self.tables:
            text, place, found = positions(words, mask)
            may = np.flatnonzero(bits[(found >> U64(42)).astype(np.int64)])
            low, high = np.searchsorted(table, found[may], "left"), np.searchsorted(table, found[may], "right")
            count = high - low
            which = np.repeat(may, count)
            entry = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            met.append(np.stack([text[which], item[entry], place[which] - words.first[text[which]] - at[entry]], axis=1))
        if not met:
            return
        rows = np.unique(np.concatenate(met), axis=0)
        cuts = np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0), axis=1)) + 1
        for part in np.split(rows, cuts) if len(rows) else ():
            yield int(part[0, 0]), int(part[0, 1]), set(part[:, 2].tolist())

    def found(self, texts: list[bytes]) -> dict[tuple[int, int | None], int]:
        """(text, item) -> words of the item that the text has."""
        out: dict[tuple[int, int | None], int] = {}
        for begin, end in chunks([len(t) for t in texts]):
            words = words_of(texts[begin:end])
            for text, item, diagonals in self.hits(words):
                n = overlap(words.hashes[words.first[text] : words.first[text + 1]], self.items[item], diagonals)
                if n:
                    key = (begin + text, self.ids[item])
                    out[key] = max(n, out.get(key, 0))
        return out

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), self.found([normal(t) for t in batch.column(1).to_pylist()])
            yield pa.record_batch(
                [pa.array([ids[t] for t, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64()), pa.array(list(out.values()), pa.int64())],
                names=["doc_id", "item_id", "n_tokens"],
            )


def _probe(items: DataFrame, broadcast_bytes: int) -> Broadcast[Probe] | None:
    """The benchmark, ready on every executor; None where it is larger than that."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
        return None
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(Probe([r[0] for r in rows], [r[1] for r in rows]))


def contaminated(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_tokens): the documents that overlap benchmark items, and by how many words of the item."""
    docs, items = only(docs, "doc_id", "text").filter("text is not null"), only(items, "item_id", "text").filter("text is not null")
    probe = _probe(items, broadcast_bytes)
    if probe is not None:
        return docs.mapInArrow(lambda batches: probe.value.scan(batches), SCHEMA)
    a, b = _row("text")
    pairs = _joined(docs.select("text").distinct(), items)
    return docs.select("doc_id", a.alias("a"), b.alias("b")).join(loose(pairs, "a", "b"), ["a", "b"]).select("doc_id", "item_id", "n_tokens")


def _row(text: str) -> tuple[Column, Column]:
    """128 bits that name a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), F.reverse(text))


def _seeds(of_items: bool, masks: list[tuple[int, ...]], bits: Broadcast[np.ndarray] | None = None):
    """Rows (a, b, mask, hash, position) of texts named by a and b; items only under the masks made for their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column(2).to_pylist()]
            for begin, end in chunks([len(t) for t in texts], 1 << 19):
                words = words_of(texts[begin:end])
                lengths = np.diff(words.first)
                for k, mask in enumerate(masks):
                    text, at, found = positions(words, mask)
                    if of_items:
                        keep = lengths[text] >= WINDOW if mask in MASKS else lengths[text] == len(mask)
                    else:
                        place = (mix(found + U64(k)) % U64(FILTER_BITS)).astype(np.int64)
                        keep = (bits.value[place >> 3] >> (place & 7)) & 1 == 1
                    text, at, found = text[keep], at[keep], found[keep]
                    of = pa.array(text + begin)
                    yield pa.record_batch(
                        [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.full(len(text), k)), pa.array(found.view(np.int64)), pa.array(at - words.first[text])],
                        names=["a", "b", "mask", "hash", "at"],
                    )

    return run


def _bits(seeds: DataFrame) -> np.ndarray:
    """A bit for the hash of each seed; put together from parts of a fixed number and size."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
        for batch in batches:
            mask, found = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            place = (mix(found.view(U64) + mask.view(U64)) % U64(FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(whole, place >> 3, (1 << (place & 7)).astype(np.uint8))
        for k, part in enumerate(whole.reshape(-1, FILTER_PART)):
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["part", "bits"])

    def merged(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(FILTER_PART, dtype=np.uint8)
        for batch in group:
            for raw in batch.column(1):
                whole |= np.frombuffer(raw.as_buffer(), dtype=np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros((FILTER_BITS >> 3) // FILTER_PART * FILTER_PART, dtype=np.uint8).reshape(-1, FILTER_PART)
    for part, bits in seeds.select("mask", "hash").mapInArrow(parts, "part bigint, bits binary").groupBy("part").applyInArrow(merged, "part bigint, bits binary").collect():
        out[part] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, item_id, n_tokens) of distinct texts, by a shuffle join of seed hashes: for benchmarks of any size.

    Training seeds pass a filter of fixed size first. Spark splits seeds and items that are hot among
    the texts, and a text takes part whole only where it shares a seed with an item.
    """
    a, b = _row("text")
    named = texts.select(a.alias("a"), b.alias("b"), "text")
    own = items.select(F.xxhash64("item_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "item_id").alias("b"), "text", "item_id").distinct()
    schema = "a bigint, b bigint, mask bigint, hash bigint, at bigint"
    masks = masks_for(set(range(1, WINDOW + 1)))
    wanted = cut(own.select("a", "b", "text").mapInArrow(_seeds(True, masks), schema))
    bits = texts.sparkSession.sparkContext.broadcast(_bits(wanted))
    met = (
        named.mapInArrow(_seeds(False, masks, bits), schema).alias("d").join(loose(wanted, "mask", "hash").alias("i"), ["mask", "hash"])
        .groupBy(F.col("d.a").alias("a"), F.col("d.b").alias("b"), F.col("i.a").alias("ia"), F.col("i.b").alias("ib"))
        .agg(F.collect_set(F.col("d.at") - F.col("i.at")).alias("diagonals"))
    )
    both = (
        cut(met).join(named, ["a", "b"])
        .join(loose(own.select(F.col("a").alias("ia"), F.col("b").alias("ib"), F.col("text").alias("passage"), "item_id"), "ia", "ib"), ["ia", "ib"])
        .select("a", "b", "text", "item_id", "passage", "diagonals")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, text, item, passage, diagonals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of([normal(text), normal(passage)])
                n = overlap(words.hashes[: words.first[1]], words.hashes[words.first[1] :], set(diagonals))
                if n:
                    out.append((a, b, item, n))
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else ((),) * 4)], names=["a", "b", "item_id", "n_tokens"])

    found = both.mapInArrow(verify, "a bigint, b bigint, item_id bigint, n_tokens bigint")
    return found.groupBy("a", "b", "item_id").agg(F.max("n_tokens").alias("n_tokens"))


def stage(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item. Nothing is shuffled for a benchmark that can be broadcast."""
    items = only(items, "item_id", "text").filter("text is not null")
    probe = _probe(items, broadcast_bytes)
    if probe is not None:

        @F.pandas_udf("boolean")
        def leaks(texts: pd.Series) -> pd.Series:
            hit = np.zeros(len(texts), dtype=bool)
            hit[[t for t, _ in probe.value.found([normal(t) for t in texts])]] = True
            return pd.Series(hit)

        return docs.filter(~leaks(docs["text"]))
    names = [fresh(docs.columns, c) for c in ("leak_a", "leak_b")]
    pairs = _joined(only(docs, "text").filter("text is not null").distinct(), items).select("a", "b").distinct()
    bad = loose(pairs, "a", "b").select(F.col("a").alias(names[0]), F.col("b").alias(names[1]))
    a, b = _row("text")
    return docs.join(bad, (a == bad[names[0]]) & (b == bad[names[1]]), "left_anti")
