"""What bounds the searches for repeated passages: hot anchors, long texts, and the two indexes."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from test_anywhere import passages_anywhere
from test_searches import passage_rows

from siltstone.llm import common, lempel_ziv_dedup, repeats, runlength_dedup


@pytest.mark.parametrize("anywhere", [False, True])
@pytest.mark.parametrize("hot", [0, 5])
def test_windows_of_hot_anchors_are_found_alike(spark, hot, anywhere):
    rows = [*passage_rows(), (700, " ".join(brute.prose(800, 70) * 2))]
    got = repeats.repeated_spans(spark.createDataFrame(rows, brute.SCHEMA), runlength_dedup.find, anywhere, hot).collect()
    want = (passages_anywhere if anywhere else brute.passages)(rows, 50)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_one_passage_in_twenty_thousand_documents(spark):
    passage = " ".join(brute.prose(1, 60))
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"concat(id, ' ', id * 7, ' {passage} ', id * 13) AS text")
    got = lempel_ziv_dedup.duplicates(docs)
    assert [tuple(r) for r in got.groupBy("start_word", "end_word").count().collect()] == [(2, 62, 20_000)]


def test_long_texts_are_cut_into_pieces_without_a_trace(monkeypatch):
    rng = random.Random(4)
    raw = [" ".join(brute.prose(5, 4000)).encode(), b"", b" \n ", b"one", ("x" * 5000).encode(), " ".join(rng.choice("ab") for _ in range(3000)).encode() + b" \t"]
    whole = common.words_of(raw)
    anchored = repeats.anchors(whole)
    monkeypatch.setattr(common, "PIECE", 300)
    cut = common.words_of(raw)
    assert (cut.hashes == whole.hashes).all() and (cut.first == whole.first).all() and cut.first.tolist()[-1] == 4000 + 1 + 1 + 3000
    monkeypatch.setattr(repeats, "RANGE", 400)
    ranged = repeats.anchors(cut)

    def windows(found):  # the anchor of each window
        return {(int(t), int(s)): int(at) for t, at, (a, b) in zip(found[0], found[1], found[3], strict=True) for s in range(a, b + 1)}

    assert windows(ranged) == windows(anchored) and len(windows(anchored)) == 4000 + 3000 - 98


def block_of(texts: list[list[int]]) -> repeats.Block:
    heads = np.array([(k // 2, 10 * k, len(t)) for k, t in enumerate(texts)], dtype=np.int64)
    return repeats.Block(heads, np.array([w for t in texts for w in t], dtype=np.uint32))


def plain_spans(block: repeats.Block, anywhere: bool) -> list[tuple[int, int, int]]:
    n, least = len(block.symbols), repeats.LEAST
    windows: dict[tuple, list[int]] = {}
    for p in range(n - least + 1):
        if block.stretch[p] == block.stretch[p + least - 1] and block.symbols[p + least - 1] > block.symbols[-1]:
            windows.setdefault(tuple(block.symbols[p : p + least].tolist()), []).append(p)
    owner = repeats.owners(block, anywhere)
    at = np.array(sorted(p for found in windows.values() if len({int(owner[p]) for p in found}) > 1 for p in found), dtype=np.int64)
    return [tuple(x) for x in repeats.covered(block.doc[at], block.word[at], block.word[at] + least).tolist()]


def repetitive(seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    base = [[rng.randrange(50) for _ in range(90)] for _ in range(3)] + [[7] * 80]
    out = []
    for _ in range(160):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 0, 1, 3))):
            text[rng.randrange(len(text))] = rng.randrange(50)
        a = rng.randrange(0, 20)
        out.append(text[a : rng.randrange(max(a + 1, 50), len(text) + 1)])
    return out


@pytest.mark.parametrize("anywhere", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_blocks_have_the_spans_of_the_plain_version(seed, anywhere):
    block = block_of(repetitive(seed))
    want = plain_spans(block, anywhere)
    assert [tuple(x) for x in runlength_dedup.find(block, anywhere, step=333).tolist()] == want
    assert [tuple(x) for x in lempel_ziv_dedup.find(block, anywhere).tolist()] == want and want


def test_matching_statistics_are_those_of_the_suffix_array():
    block = block_of(repetitive(9))
    index = runlength_dedup.RunLengthIndex(block.symbols)
    order, rank = repeats.suffix_array(block.symbols, runlength_dedup.DEPTH)
    above, shared = index.statistics(0, index.n)
    for p in range(0, index.n, 7):
        if rank[p] == 0:
            assert shared[p] == 0
            continue
        q, n = int(order[rank[p] - 1]), 0
        while max(p, q) + n < index.n and block.symbols[p + n] == block.symbols[q + n]:
            n += 1
        assert shared[p] == n and (n == 0 or above[p] == q)


def test_the_index_is_smaller_than_the_suffix_array_of_a_repetitive_block():
    block = block_of([list(range(90))] * 2000)
    index = runlength_dedup.RunLengthIndex(block.symbols)
    assert index.nbytes < 0.1 * 4 * len(block.symbols)


def test_matches_are_looked_up_at_factors_and_boundaries_only(monkeypatch):
    rng = random.Random(1)
    passage = [rng.randrange(10**6) for _ in range(85)]
    block = block_of([passage if k % 9 == 0 else [rng.randrange(10**6) for _ in range(20)] + passage[:8] + [rng.randrange(10**6) for _ in range(60)] for k in range(400)])
    seen = []
    plain = lempel_ziv_dedup.Reference.longest
    monkeypatch.setattr(lempel_ziv_dedup.Reference, "longest", lambda self, at: (seen.append(len(at)), plain(self, at))[1])
    found = lempel_ziv_dedup.find(block)
    assert [tuple(x) for x in found.tolist()] == plain_spans(block, False)
    assert sum(seen) < 0.95 * len(block.symbols)


def test_a_hot_key_is_split_where_the_other_side_is_loose(spark):
    from pyspark.sql import functions as F

    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for k, v in zip(old, ("64", "-1", "200k", "100k"), strict=True):
        spark.conf.set(k, v)
    try:
        rows = common.cut(spark.range(400_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS a", "id AS x").repartition(8))
        least = rows.groupBy("a").agg(F.min("x").alias("m"))
        found = []
        for side in (common.loose(least, "a"), least):
            joined = rows.join(side, "a").filter("x > m")
            n = len(joined.collect())
            found.append((n, "skew=true" in joined._jdf.queryExecution().executedPlan().toString()))  # noqa: SLF001
        assert found == [(133_334, True), (133_334, False)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
