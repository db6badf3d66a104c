"""What the two searches for repeated passages share: cutting the corpus into bounded sets that hold them.

A passage of ``LEAST`` words is a window. Each window has an anchor: of its runs of ``GRAM`` words the
one with the smallest hash, the last of equals. Equal windows have equal anchors, so a window can only
repeat where its anchor does, and whatever repeats shares a bucket: the stretches of text around the
occurrences of an anchor all go to the bucket that the anchor's hash names. Anchors that a single
document has (or of a single place, if passages within a document count) are dropped before any text
is moved. Nothing is sampled: all windows with a repeated anchor are in the stretches, whole.

An anchor of more than ``HOT`` places would make its bucket grow with the corpus. The windows of such
anchors are looked for exactly instead: each is hashed to 128 bits, windows are counted by an aggregate
that combines before the shuffle, and those of two documents are joined back, where Spark splits the
hot ones. So no task ever holds what an anchor or a window has in the whole corpus.

Words are runs of bytes between white space. Positions count words from 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import U64, Words, chunks, cut, grams, loose, mix, only, powers, raw_bytes, words_of

LEAST, GRAM = 50, 8
#: Words in the stretches of a bucket, about; places that an anchor may have to be in one; bytes of stretches in a partition.
BUCKET_WORDS, HOT, PART_BYTES = 300_000, 2000, 64 << 20
#: Words of a text that are looked at together; fewer than the positions that the low bits of a key can tell.
RANGE, LOW = 1 << 19, (1 << 21) - 1
SPANS = "doc_id bigint, start_word bigint, end_word bigint"
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros((0, 2), np.int64))


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash, windows): anchors in order, each with the windows before the next that have it.

    ``windows`` is (n, 2): the first and last start of windows whose anchor this is. Long texts are done in
    ranges of words that overlap, each window in one.
    """
    found = [_anchors(words, at, min(at + RANGE, len(words.hashes))) for at in range(0, len(words.hashes), RANGE - LEAST + 1)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else _NONE


def _anchors(words: Words, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashed = grams(words.hashes[begin:end], GRAM)
    span = LEAST - GRAM + 1
    n = end - begin - LEAST + 1
    if n <= 0:
        return _NONE
    # the smallest of ``span`` hashes by doubling; the position in the low bits picks the last of equals
    key = (hashed & ~U64(LOW)) | (U64(LOW) - np.arange(len(hashed), dtype=U64))
    size = 1
    while 2 * size <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[:n], key[span - size : span - size + n])
    text = np.searchsorted(words.first, np.arange(begin, begin + n), "right") - 1
    start = np.flatnonzero(np.arange(begin, begin + n) + LEAST <= words.first[text + 1])
    if not len(start):
        return _NONE
    at = (U64(LOW) - (key[start] & U64(LOW))).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[start[1:]] != text[start[:-1]])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    return text[start[first]], at[first] + begin, hashed[at[first]], np.stack([start[first], start[last]], axis=1) + begin


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), [raw_bytes(t) for t in batch.column(1).to_pylist()]
        own = batch.column(2).to_numpy(zero_copy_only=False)
        for begin, end in chunks([len(t) for t in texts]):
            text, _, hashed, _ = anchors(words_of(texts[begin:end]))
            _, one, times = np.unique(_pair(text, hashed), return_index=True, return_counts=True)
            text = text[one] + begin
            yield pa.record_batch([pa.array(hashed[one].view(np.int64)), pa.array(own[text]), pa.array(ids[text]), pa.array(times.astype(np.int64))], names=["anchor", "own", "doc_id", "places"])


def _wanted(batch: pa.RecordBatch, column: int, begin: int, end: int, text: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the anchors are in the lists that the rows of the batch have."""
    part = batch.column(column).slice(begin, end - begin)
    owner = np.repeat(np.arange(end - begin), pc.list_value_length(part).to_numpy(zero_copy_only=False))
    asked = _pair(owner, part.flatten().to_numpy(zero_copy_only=False).view(U64))
    return np.flatnonzero(np.isin(_pair(text, hashed), asked)) if len(asked) else np.zeros(0, np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... start + size - 1, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _stretches(buckets: int):
    """Stretches, packed by bucket and batch: heads (document, first word, words) and words; and the windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [raw_bytes(t) for t in batch.column(1).to_pylist()]
            for begin, end in chunks([len(t) for t in texts], 1 << 20):
                words = words_of(texts[begin:end])
                text, _, hashed, windows = anchors(words)
                hit = _wanted(batch, 2, begin, end, text, hashed)
                if len(hit):
                    bucket = (mix(hashed[hit]) % U64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    hit, bucket = hit[order], bucket[order]
                    start, size = windows[hit, 0], windows[hit, 1] - windows[hit, 0] + LEAST
                    payload = (words.hashes[_ranges(start, size)] >> U64(32)).astype(np.uint32)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                    ends = np.concatenate([[0], np.cumsum(size)])
                    heads = np.stack([ids[text[hit] + begin], start - words.first[text[hit]], size], axis=1).astype(np.int64)
                    pieces = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    yield pa.record_batch(
                        [
                            pa.array(bucket[cuts[:-1]].astype(np.int32)),
                            pa.array([heads[a:b].tobytes() for a, b in pieces], pa.binary()),
                            pa.array([payload[ends[a] : ends[b]].tobytes() for a, b in pieces], pa.binary()),
                        ],
                        names=["bucket", "heads", "words"],
                    )
                hit = _wanted(batch, 3, begin, end, text, hashed)
                if len(hit):
                    start, size = windows[hit, 0], windows[hit, 1] - windows[hit, 0] + 1
                    at, owner = _ranges(start, size), np.repeat(text[hit], size)
                    marks = np.empty((len(at), 4), dtype=np.int64)
                    marks[:, 0], marks[:, 1] = window_hashes(words.hashes, at)
                    marks[:, 2], marks[:, 3] = ids[owner + begin], at - words.first[owner]
                    yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([marks.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["bucket", "heads", "words"])

    return run


def window_hashes(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the window from each place, in two halves."""
    own, other = np.zeros(len(at), dtype=U64), np.zeros(len(at), dtype=U64)
    for k in range(LEAST):
        word = hashes[at + k]
        own = own * U64(0x9E3779B97F4A7C15) + word
        other = other * U64(0xC2B2AE3D27D4EB4F) + mix(word)
    return mix(own).view(np.int64), mix(other).view(np.int64)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            marks = np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, 4)
            yield pa.record_batch([pa.array(np.ascontiguousarray(marks[:, c])) for c in range(4)], names=["a", "b", "doc_id", "start_word"])


def _pair(owner: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    return mix(hashed + owner.astype(U64) * U64(0x9E3779B97F4A7C15))


class Block:
    """The stretches of a bucket, joined: words as dense numbers, each stretch ended by a number of its own."""

    __slots__ = ("symbols", "doc", "word", "stretch", "docs")

    def __init__(self, heads: np.ndarray, words: np.ndarray):
        size = heads[:, 2]
        n, k = len(words), len(heads)
        self.stretch = np.repeat(np.arange(k, dtype=np.int32), size + 1)
        end = np.cumsum(size + 1) - 1
        inside = np.ones(n + k, dtype=bool)
        inside[end] = False
        dense = np.unique(words, return_inverse=True)[1]
        self.symbols = np.empty(n + k, dtype=np.int32)
        self.symbols[inside] = dense + k
        self.symbols[end] = np.arange(k)
        self.docs, local = np.unique(heads[:, 0], return_inverse=True)
        self.doc = np.repeat(local.astype(np.int32), size + 1)
        self.word = np.repeat(heads[:, 1] - (np.cumsum(size + 1) - size - 1), size + 1) + np.arange(n + k)


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each), by their first ``depth`` symbols at least; prefixes double until all are told apart."""
    n, size = len(symbols), 1
    rank, order = symbols.astype(np.int32), None
    while order is None or size < depth:
        key = rank.astype(np.int64) << 32
        key[:-size] |= rank[size:].astype(np.int64) + 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.int32)
        size *= 2
        if rank[order[-1]] == n - 1:  # all are told apart
            break
    return order.astype(np.int32), rank


class Prefixes:
    """Hashes of all prefixes of a block, by which the words that two places have in common are counted."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.n, self.depth = len(symbols), depth
        up, down = powers(self.n + 1)
        self.down = down
        self.total = np.zeros(self.n + 1, dtype=U64)
        np.cumsum(mix(symbols.astype(U64)) * up[:-1], out=self.total[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of places a and b, below twice ``depth`` (a power of two)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        length, step = np.zeros(len(a), dtype=np.int64), self.depth
        while step:
            x, y = a + length, b + length
            fits = np.maximum(x, y) + step <= self.n
            x, y = np.where(fits, x, 0), np.where(fits, y, 0)
            to = np.where(fits, step, 0)
            same = fits & ((self.total[x + to] - self.total[x]) * self.down[x] == (self.total[y + to] - self.total[y]) * self.down[y])
            length += np.where(same, step, 0)
            step //= 2
        return length


def covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(doc, start, end) of the union of spans, in order."""
    if not len(doc):
        return np.zeros((0, 3), dtype=np.int64)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order].astype(np.int64), start[order], end[order]
    far = np.maximum.accumulate(end + doc * (1 << 40)) - doc * (1 << 40)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return np.stack([doc[first], start[first], far[last]], axis=1)


def owners(block: Block, anywhere: bool) -> np.ndarray:
    """What of each place of the block must differ for two equal windows to be a repeat: the document, or the place in it."""
    return (block.doc.astype(np.int64) << 40) + block.word if anywhere else block.doc


def repeated_spans(docs: DataFrame, find: Callable[[Block, bool], np.ndarray], anywhere: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): unions of the windows that ``find`` has in blocks.

    ``find`` takes a block and ``anywhere``, and returns the spans (document in the block, first word, end).
    With ``anywhere``, windows also count that repeat at two places of one document. Anchors of more than
    ``hot`` places are dealt with window by window, to the same result.
    """
    # ``own`` names a text: rows of one text have the same anchors, and one list of them is enough
    docs = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("own", F.xxhash64("text"))
    rows = cut(docs.select("doc_id", "text", "own").mapInArrow(_anchor_rows, "anchor bigint, own bigint, doc_id bigint, places bigint"))
    shared = (
        rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("places").alias("n"))
        .filter("n > 1" if anywhere else "a < b").select("anchor", "n", (F.col("n") > hot).alias("hot"))
    )
    shared = cut(shared)
    asked = rows.select("anchor", "own").join(loose(shared, "anchor"), "anchor")
    lists = asked.groupBy("own").agg(*[F.collect_set(F.when(F.col("hot") == is_hot, F.col("anchor"))).alias(name) for name, is_hot in (("cold", False), ("warm", True))])
    words = (shared.filter("not hot").agg(F.sum("n")).first()[0] or 0) * (LEAST + (LEAST - GRAM + 2) / 2)
    buckets = max(1, math.ceil(words / BUCKET_WORDS))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(buckets, max(least, math.ceil(4 * words / PART_BYTES)))
    stretches = docs.join(loose(lists, "own"), "own").select("doc_id", "text", "cold", "warm").mapInArrow(_stretches(buckets), "bucket int, heads binary, words binary")
    stretches = cut(stretches)  # read twice: buckets, and windows of hot anchors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after another; one is held at a time."""
        held: list[tuple[bytes, bytes]] = []
        now = None

        def found() -> pa.RecordBatch:
            heads = np.frombuffer(b"".join(h for h, _ in held), dtype=np.int64).reshape(-1, 3)
            block = Block(heads, np.frombuffer(b"".join(w for _, w in held), dtype=np.uint32))
            held.clear()
            doc, start, end = find(block, anywhere).T
            return pa.record_batch([pa.array(block.docs[doc]), pa.array(start), pa.array(end)], names=["doc_id", "start_word", "end_word"])

        for batch in batches:
            for bucket, heads, words in zip(*batch.columns, strict=True):
                if bucket.as_py() != now and held:
                    yield found()
                now = bucket.as_py()
                held.append((heads.as_py(), words.as_py()))
        if held:
            yield found()

    blocks = stretches.filter("bucket >= 0").repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    every = stretches.filter("bucket < 0").select("heads").mapInArrow(_unpacked, "a bigint, b bigint, doc_id bigint, start_word bigint")
    if anywhere:
        twice = (F.min("doc_id") < F.max("doc_id")) | (F.min("start_word") < F.max("start_word"))
    else:
        twice = F.min("doc_id") < F.max("doc_id")
    repeated = every.groupBy("a", "b").agg(twice.alias("twice")).filter("twice").select("a", "b")
    warm = every.join(loose(repeated, "a", "b"), ["a", "b"]).select("doc_id", "start_word", (F.col("start_word") + LEAST).alias("end_word"))
    found = blocks.mapInArrow(search, SPANS).unionByName(warm).groupBy("doc_id", "start_word").agg(F.max("end_word").alias("end_word"))
    before = Window.partitionBy("doc_id").orderBy("start_word").rowsBetween(Window.unboundedPreceding, -1)
    marked = found.withColumn("new", (F.col("start_word") > F.coalesce(F.max("end_word").over(before), F.lit(-1))).cast("int"))
    island = F.sum("new").over(Window.partitionBy("doc_id").orderBy("start_word").rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("island", island).groupBy("doc_id", "island")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
    )


SQL = rf"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\f\r ]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT doc_id, i AS start, array_to_string(w[i + 1 : i + {LEAST}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {LEAST - 1})) AS i FROM words WHERE len(w) >= {LEAST})),
repeated AS (
  SELECT DISTINCT doc_id, start FROM windows
  WHERE g IN (SELECT g FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id))),
marked AS (
  SELECT doc_id, start, start > coalesce(lag(start) OVER (PARTITION BY doc_id ORDER BY start) + {LEAST}, -1) AS fresh FROM repeated),
islands AS (
  SELECT doc_id, start, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM marked)
SELECT doc_id, min(start)::bigint AS start_word, (max(start) + {LEAST})::bigint AS end_word, (max(start) + {LEAST} - min(start))::bigint AS n_words
FROM islands GROUP BY doc_id, island"""
