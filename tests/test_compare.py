"""The comparison of analyzers against a plain version."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from siltstone.operators import search

TEXTS = ["red apples grow", "the red apple", "green pears and apples", "a pear", "blue skies over red hills", "the hill is red", "sky", "apples apples pears"]
#: Grades of every remainder by 7, and documents that no query finds.
LABELS = [(k, int(k != 3), 0) for k in (0, 1, 3, 4, 5, 6, 7, 20, 21)]


def plain(ranking: list[tuple[int, int, int]], relevant: set[int], queries: list[int]) -> tuple:
    """(queries, mrr, recall, ndcg): every query is judged by all relevant documents."""
    ideal = sum(1 / math.log2(p + 1) for p in range(1, min(10, len(relevant)) + 1))
    totals = [0.0, 0.0, 0.0]
    for q in queries:
        hits = sorted(rank for query, doc, rank in ranking if query == q and doc in relevant and rank <= 10)
        totals[0] += 1 / hits[0] if hits else 0
        totals[1] += len(hits) / len(relevant)
        totals[2] += sum(1 / math.log2(r + 1) for r in hits) / ideal
    return (len(queries), *[pytest.approx(t / len(queries), abs=1e-6) for t in totals])


def test_analyzers_are_judged_by_all_good_labels(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "red apples"), (2, "the pears"), (3, "missing"), (4, "skies")], "item_id bigint, text string")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", queries), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    relevant = {d for d, quality, _ in LABELS if quality == 1}
    got = {r["analyzer"]: (r["queries"], r["mrr"], r["recall"], r["ndcg"]) for r in entry.queries()["compare_analyzers"](spark, str(tmp_path)).collect()}
    for analyzer in ("default", "ascii_fold", "english_basic"):
        ranked = search.bm25_batch(docs, "doc_id", "text", queries.withColumnRenamed("item_id", "query_id"), 10, analyzer)
        assert got.pop(analyzer) == plain([(r["query_id"], r["doc_id"], r["rank"]) for r in ranked.collect()], relevant, [1, 2, 3, 4])
    assert not got
