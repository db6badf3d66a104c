"""Terms counted within rows, without a shuffle of postings, and comparison of postings by key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import find, profile, search
from siltstone.queries import QUERIES, table
from siltstone.sources import text_index

TEXTS = [(1, "b a b A. Äa äA aa"), (2, ""), (3, None), (4, "..."), (5, "z"), (6, "one two one " * 50)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain(df, key: str, analyzer: str):
    """Each term of each key, counted by a shuffle."""
    return df.select(key, F.explode(T.terms(F.col("text"), analyzer)).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


@pytest.mark.parametrize("analyzer", ["default", "ascii_fold", "english_basic", "keyword"])
@pytest.mark.parametrize("more", [[], [(1, "b z"), (None, "x"), (None, "x y")]])
def test_terms_are_counted_within_rows(spark, analyzer, more):
    df = spark.createDataFrame(TEXTS + more, "id bigint, text string")
    got, want = (sorted(map(tuple, d.collect()), key=repr) for d in (search.postings(df, "id", "text", analyzer), plain(df, "id", analyzer)))
    assert got == want


@pytest.mark.parametrize("name", ["inverted_index", "analyzed_index"])
def test_postings_are_not_shuffled(spark, small, monkeypatch, name):
    monkeypatch.setattr(text_index, "SMALL", 0)  # small tables are dealt to all cores
    assert "Exchange" not in plan(QUERIES[name](spark, small))


def test_only_keys_that_differ_are_compared_entry_by_entry(spark, small, monkeypatch):
    held = []
    monkeypatch.setattr(profile, "cut", lambda df: held.append(df.checkpoint()) or held[-1])
    got = QUERIES["index_inconsistent"](spark, small).count()
    assert held[0].filter("doc_id % 50 <> 0").isEmpty() and held[2].filter("doc_id % 50 <> 0").isEmpty() and held[2].count() == got > 0
    assert got == plain(table(spark, small, "documents").filter("doc_id % 50 = 0"), "doc_id", "default").count()


def test_entries_of_one_side_are_found_on_either(spark):
    stored = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("a", 2, 1), ("c", 3, 1), ("d", 5, 1), ("x", None, 1)], "term string, id bigint, tf bigint")
    rebuilt = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("a", 2, 1), ("d", 4, 1), ("d", 5, 1)], "term string, id bigint, tf bigint")
    got = sorted(map(tuple, profile.inconsistent(stored, rebuilt, "id").collect()), key=repr)
    assert got == sorted([("b", 1, 1), ("b", 1, 3), ("c", 3, 1), ("d", 4, 1), ("x", None, 1)], key=repr)


RANKED = ["hybrid_weighted", "hybrid_filtered", "keyword_match", "agg_search_scoped", "bm25_analyzed", "ranked_page_2", "contains_text_tf"]


def test_one_query_builds_no_index_and_uses_one_that_is_there(spark, small, tmp_path, monkeypatch):
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    build, built, read = text_index.build, [], []
    monkeypatch.setattr(text_index, "build", lambda *a: built.append(a) or build(*a))
    indexed = search.indexed
    monkeypatch.setattr(search, "indexed", lambda *a, **more: read.append(a) or indexed(*a, **more))

    def results():
        return {n: sorted(map(repr, QUERIES[n](spark, str(tmp_path)).collect())) for n in RANKED}

    without = results()
    assert not built and not read
    text_index.open_index(table(spark, str(tmp_path), "documents"), "doc_id", "text")
    assert results() == without and len(built) == 1 and len(read) >= len(RANKED)


def test_hybrid_reads_texts_without_the_join_of_vectors(spark, small, monkeypatch):
    seen = []
    bm25 = search.bm25
    monkeypatch.setattr(search, "bm25", lambda df, *a: seen.append(plan(df)) or bm25(df, *a))
    monkeypatch.setattr("siltstone.queries.held", lambda *a: None)
    assert QUERIES["hybrid_weighted"](spark, small).count() == 10 and len(seen) == 1 and "Join" not in seen[0]


@pytest.mark.parametrize("name", ["keyword_match", "bm25_and"])
def test_texts_that_nobody_asks_for_are_not_ordered_and_written(spark, small, monkeypatch, name):
    seen = []
    ordered = find.page
    monkeypatch.setattr(find, "page", lambda df, *a: seen.append(df.columns) or ordered(df, *a))
    assert QUERIES[name](spark, small).count() and seen == [["doc_id", "score", "text_score", "vector_score"]]
