"""Near-duplicate documents by SimHash and a search in lists of equal strips.

A fingerprint of 256 bits holds the signs of the summed hashes of a document's distinct word pairs.
Near duplicates are fingerprints that differ in at most ``DISTANCE`` bits. Those that are equal on a
random strip of coordinates make a list: the filter of May and Ozerov with weight 0 from every centre.
Two close fingerprints meet in a list far more often than two others. The strip is as long as the number
of fingerprints asks for, so that lists stay short at every size; up to ``LEAF`` they are searched by
brute force, longer ones are parted by further strips. All is repeated with other strips as often as the
target recall needs at ``DISTANCE``: half of what may be missed is left to the strips of the shuffled
lists, the other half to the recursion, halved again at each depth. So the recall holds at every size.
Strips of the shuffle end at ``STRIP`` coordinates, which bounds its entries; where lists would outgrow
a task for that, they are filtered twice before. Groups are the connected components of what is found.

Equal fingerprints are one point of the search and of the components, so copies by the thousand cost
nothing: they are joined with their point's group at the end, where Spark splits the hot ones.

Defined results
* a null text, or one without words, is no duplicate of anything.
* a text of one word has the fingerprint of that word.
* ``groups`` names documents: rows of the same doc_id are one document; one whose rows differ is in the
  group of either text. A null doc_id can't be named, and is in no group.
* the stage judges rows by their text. Of a group the row with the smallest doc_id stays, those without
  one last and ties by a hash of the text; of rows equal in doc_id and text one stays.
* an empty table has no groups; further columns are ignored, or carried along by the stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import U64, chunks, cut, fresh, loose, mix, normal, only, words_of

BITS = 256
#: Fingerprints that differ in so many bits are near; a pair at that distance is found with a probability of ``RECALL`` at least.
DISTANCE, RECALL = 56, 0.95
#: Lists up to this length are searched by brute force; entries above which shuffled lists are filtered twice.
LEAF, LONGEST = 2048, 1_000_000
#: Entries of a shuffled list that its strip's length is chosen for, and the most coordinates of such a strip.
LIST, STRIP = 1024, 14
SEED = 77
#: Bytes of packed list entries in one partition, about.
PART_BYTES = 24 << 20
#: Points of one task that makes entries, and entries that it makes at a time.
POINTS, AT_ONCE = 1 << 14, 1 << 19
#: Pairs that brute force compares at a time, in arrays that a core's cache holds.
CELLS = 1 << 16
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("fp", "<u8", (4,))])
POINT = ("a", "b", "c", "d")


# --------------------------------------------------------------------------- fingerprints


def fingerprints(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n, 4) of normalised texts, and which texts have words at all."""
    words = words_of(raw)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(raw), dtype=np.uint64), counts)
    h = words.hashes
    out = np.zeros((len(raw), 4), dtype=U64)
    if not len(h):
        return out, counts > 0
    pair = np.empty_like(h)
    pair[:-1] = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    pair[-1:] = h[-1:]
    last = words.first[1:][counts > 0] - 1
    keep = np.ones(len(h), dtype=bool)
    keep[last[counts[counts > 0] > 1]] = False
    pair[last] = h[last]
    key = np.sort((text[keep] << U64(48)) | (pair[keep] >> U64(16)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> U64(48)).astype(np.int64)
    feature = key & U64((1 << 48) - 1)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.diff(np.concatenate([begin, [len(owner)]]))
    sums = np.zeros((len(begin), BITS), dtype=np.int32)
    rank = np.repeat(np.arange(len(begin)), size)
    for low in range(0, len(feature), 255 << 12):  # long texts take several turns
        part = feature[low : low + (255 << 12)]
        packed = np.stack([mix(part + U64(c * 0x632BE59BD9B4E019 % (1 << 64))) for c in (1, 2, 3, 4)], axis=1).view(np.uint8)
        of = rank[low : low + len(part)]
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=len(begin)))
        for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for piece in range(at, end, 255):  # as many as a byte can count
                bits = np.unpackbits(packed[piece : min(piece + 255, end)].ravel()).reshape(-1, BITS)
                sums[of[at]] += np.add.reduce(bits, axis=0, dtype=np.uint8)
    tie = np.add.reduceat(feature, begin)
    toss = np.unpackbits(np.stack([mix(tie + U64(c)) for c in (5, 6, 7, 8)], axis=1).view(np.uint8), axis=1)
    sign = np.where(2 * sums == size[:, None], toss, 2 * sums > size[:, None]).astype(np.uint8)
    out[owner[begin]] = np.packbits(sign, axis=1).view(U64)
    return out, counts > 0


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the last, which is the text, and its fingerprint in four."""
    for batch in batches:
        texts = [normal(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        for begin, end in chunks([max(len(t), 9) for t in texts], 1 << 19):  # fewer than 2**16 texts
            fps, has = fingerprints(texts[begin:end])
            some = np.flatnonzero(has)
            kept = [batch.column(c).take(pa.array(some + begin)) for c in range(batch.num_columns - 1)]
            yield pa.record_batch([*kept, *(pa.array(np.ascontiguousarray(fps[some, c]).view(np.int64)) for c in range(4))], names=[*batch.schema.names[:-1], *POINT])


# --------------------------------------------------------------------------- the filters


def strip_values(fps: np.ndarray, strip: np.ndarray) -> np.ndarray:
    """The bits of ``strip`` of each fingerprint, as one number."""
    value = np.zeros(len(fps), dtype=U64)
    for k, bit in enumerate(strip.tolist()):
        value |= ((fps[:, bit >> 6] >> U64(bit & 63)) & U64(1)) << U64(k)
    return value


def strip_length(n: int, size: int, most: int = 32) -> int:
    """Coordinates of a strip that parts ``n`` fingerprints into lists of ``size`` at most, if they are even."""
    return min(most, max(1, math.ceil(math.log2(max(n, 1) / max(size, 1)))))


def strip_of(length: int, *seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, *seed]).permutation(BITS)[:length]


def repetitions(length: int, recall: float, distance: int = DISTANCE) -> int:
    """How many strips find a pair at ``distance`` with probability ``recall``."""
    met = math.comb(BITS - distance, length) / math.comb(BITS, length)
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


# --------------------------------------------------------------------------- within a list


def components(fps: np.ndarray, distance: int, label: np.ndarray) -> np.ndarray:
    """``label`` with the smallest one of all rows linked by pairs within ``distance``; by brute force."""
    n = len(fps)
    step = max(1, min(n, CELLS // max(n, 1)))
    links = []
    words = [np.ascontiguousarray(fps[:, k]) for k in range(4)]
    differ, count, more = np.empty(step * n, dtype=U64), np.empty(step * n, dtype=np.uint8), np.empty(step * n, dtype=np.uint8)
    for at in range(0, n, step):
        end = min(at + step, n)
        x, bits, y = (r[: (end - at) * (n - at)].reshape(end - at, n - at) for r in (differ, count, more))
        # three quarters of the bits rule nearly all pairs out, where half would leave a tenth
        for k in range(3):
            np.bitwise_xor(words[k][at:end, None], words[k][None, at:], out=x)
            np.bitwise_count(x, out=y if k else bits)
            if k:
                np.add(bits, y, out=bits)
        some = np.flatnonzero(bits <= distance)
        a, b = np.divmod(some, n - at)
        rest = np.bitwise_count(words[3][at + a] ^ words[3][at + b])
        near = (rest.astype(np.int64) + bits.ravel()[some] <= distance) & (b > a)
        if near.any():
            a, b = a[near] + at, b[near] + at
            label = spread(label, a, b)  # already now, so that large cliques need no list of all pairs
            links.append(forest(a, b, n))
    if links:
        pairs = np.concatenate(links)
        label = spread(label, pairs[:, 0], pairs[:, 1])
    return label


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Pairs that link the same rows as (a, b) do, fewer than n."""
    label = spread(np.arange(n), a, b)
    own = np.flatnonzero(label != np.arange(n))
    return np.stack([label[own], own], axis=1)


def spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = label.copy()
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)


def search(fps: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF, depth: int = 0, key: int = 0) -> np.ndarray:
    """For each row of a list the smallest row that it is linked to: recursion, then brute force.

    ``key`` names the list: each has strips of its own, so that what one misses the others don't.
    """
    label = np.arange(len(fps))
    if len(fps) <= leaf:
        return components(fps, distance, label)
    length = strip_length(len(fps), max(1, leaf // 8))
    for k in range(repetitions(length, 1 - (1 - RECALL) / 2 ** (depth + 2), distance)):
        values = strip_values(fps, strip_of(length, 2, key, depth, k))
        order = np.argsort(values, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
            if len(part) < 2:
                continue
            # a list that hardly shrank holds one cluster; filtering it again would not part it
            found = components(fps[part], distance, np.arange(len(part))) if len(part) > len(fps) // 2 else search(fps[part], distance, leaf, depth + 1, (key * 31 + (k << length) + int(values[part[0]])) % (1 << 63))
            own = np.flatnonzero(found != np.arange(len(part)))
            if len(own):
                label = spread(label, part[own], part[found[own]])
    return label


# --------------------------------------------------------------------------- the search on Spark


def _emit(length: int, trees: int, again: int, buckets: int):
    """Each fingerprint's list entries, packed by bucket: few rows for the shuffle, none of them wide.

    A list is the value of a strip; where ``again`` is not 0, that of a strip with each of so many others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [strip_of(length, 0, k) for k in range(trees)]
        more = [strip_of(length, 1, k) for k in range(again)]
        step = max(1, AT_ONCE // (trees * max(again, 1)))
        for batch in batches:
            every_id = batch.column(0).to_numpy(zero_copy_only=False)
            every_fp = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4)], axis=1).view(U64)
            for low in range(0, len(every_id), step):
                ids, fps = every_id[low : low + step], every_fp[low : low + step]
                keys = [mix(strip_values(fps, strip) + U64((k << 32) + 1)) for k, strip in enumerate(made)]
                second = [mix(strip_values(fps, strip) + U64((k << 32) + 2)) for k, strip in enumerate(more)]
                if more:
                    keys = [mix(one * U64(3) + two) for one in keys for two in second]
                key = np.concatenate(keys)
                bucket = (key % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                every = np.empty(len(order), dtype=ENTRY)
                row = order % len(ids)
                every["key"], every["id"], every["fp"] = key[order], ids[row], fps[row]
                bucket = bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                yield pa.record_batch(
                    [pa.array(bucket[cuts[:-1]]), pa.array([every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    names=["bucket", "entries"],
                )

    return run


def _lists(distance: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [x for batch in batches for x in batch.column(0).to_pylist()]
        every = np.frombuffer(b"".join(raw), dtype=ENTRY)
        del raw
        every = every[np.argsort(every["key"], kind="stable")]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(every["key"])) + 1, [len(every)]]) if len(every) else np.zeros(1, np.int64)
        pairs = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                ids = every["id"][a:b]
                order = np.argsort(ids)
                found = search(np.ascontiguousarray(every["fp"][a:b][order]), distance, leaf, 0, int(every["key"][a] >> U64(1)))
                own = np.flatnonzero(found != np.arange(b - a))
                if len(own):
                    pairs.append(np.stack([ids[order][own], ids[order][found[own]]], axis=1))
        links = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
        yield pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) with a > b: large-star and small-star steps until nothing changes.

    Each round is written to the shared folder, so that the plan doesn't grow.
    """
    links = cut(links.filter("a > b").distinct())
    seen = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(loose(low, "a"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every node to the smallest neighbour of its smaller ones
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(loose(least, "a"), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        links = cut(small.filter("a > b").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(now) == seen and now[0] == now[2]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)


def linked(marks: DataFrame, distance: int = DISTANCE, leaf: int = LEAF, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Points (a, b, c, d, id), a row for each fingerprint, and links (a, b) of their ids, a > b."""
    points = cut(marks.select(*POINT).distinct().withColumn("id", F.monotonically_increasing_id()))
    n = points.count()
    length = strip_length(n, LIST, STRIP)
    levels = 1 if n / 2**length <= longest else 2
    times = repetitions(length, 1 - (1 - RECALL) / 2 / levels, distance)
    buckets = max(1, math.ceil(n * times**levels * ENTRY.itemsize / PART_BYTES))
    makers = max(1, math.ceil(n / POINTS))
    lists = points.select("id", *POINT).repartition(makers).mapInArrow(_emit(length, times, times if levels > 1 else 0, buckets), "bucket int, entries binary")
    return points, lists.repartitionById(buckets, F.col("bucket")).select("entries").mapInArrow(_lists(distance, leaf), "a bigint, b bigint")


def groups(docs: DataFrame, distance: int = DISTANCE, leaf: int = LEAF) -> DataFrame:
    """(doc_id, group_id) of the documents that have near duplicates; group_id is the smallest doc_id."""
    docs = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    marks = cut(docs.mapInArrow(_fingerprint_rows, "doc_id bigint, a bigint, b bigint, c bigint, d bigint"))
    points, links = linked(marks, distance, leaf)
    members = cut(marks.join(loose(points, *POINT), [*POINT]).select("doc_id", "id"))
    # rows of one document that differ
    apart = members.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("top")).filter("b < top")
    same = members.join(loose(apart, "doc_id"), "doc_id").filter("id > b").select(F.col("id").alias("a"), "b")
    named = _named(members, connected(links.unionByName(same)))
    first = named.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.max("doc_id").alias("last")).filter("group_id < last").select("root", "group_id")
    return named.join(loose(first, "root"), "root").select("doc_id", "group_id").distinct()


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the root of their point."""
    return members.join(loose(roots, "node", "root"), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("id", "node")


def stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one stays, and all that are in none."""
    x, y = F.xxhash64(docs["doc_id"], docs["text"]), F.xxhash64(F.lit(1), docs["text"], docs["doc_id"])
    rows = docs.filter(docs["text"].isNotNull()).select(x.alias("x"), y.alias("y"), docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    marks = cut(rows.mapInArrow(_fingerprint_rows, "x bigint, y bigint, doc_id bigint, a bigint, b bigint, c bigint, d bigint"))
    points, links = linked(marks)
    members = marks.join(loose(points, *POINT), [*POINT]).drop(*POINT)
    named = cut(_named(members, connected(links)))
    place = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "x", "y")
    best = named.groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "best")
    judged = cut(named.join(loose(best, "root"), "root").select("x", "y", (place > F.col("best")).alias("gone")))
    gone = judged.filter("gone").select("x", "y").distinct()
    again = cut(judged.filter("not gone").groupBy("x", "y").count().filter("count > 1").select("x", "y"))
    names = [fresh(docs.columns, c) for c in ("copy_x", "copy_y")]

    def without(keys: DataFrame, how: str) -> DataFrame:
        side = loose(keys, "x", "y").select(F.col("x").alias(names[0]), F.col("y").alias(names[1]))
        return docs.join(side, (x == side[names[0]]) & (y == side[names[1]]), how)

    kept = without(gone, "left_anti")
    if again.isEmpty():
        return kept
    one = without(again, "left_semi").withColumns({names[0]: x, names[1]: y}).dropDuplicates(names).drop(*names)
    return without(gone.unionByName(again), "left_anti").unionByName(one)
