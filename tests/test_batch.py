"""Batches of queries that are scored beside the texts, and measures without pairs of query and judgment."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import batch, relevance, search

WORDS = ["the", "of", "apples", "Äpfel", "apfel", "flies", "fly", "ches", "shes", "boxes", "box", "class", "lens", "this", "straße", "strasse", "x9", "9", "Œuvre", "oeuvre"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for i in range(300)]
    rows += [(i, rows[i % 3][1]) for i in range(300, 340)] + [(340, None), (341, ""), (342, "...")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(f"q{i}", " ".join(rng.choices([*WORDS, "nowhere"], k=5))) for i in range(12)] + [("none", "nowhere")], "query_id string, text string")


def rows(df) -> list[tuple]:
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in df.collect())


@pytest.mark.parametrize("analyzer", ["default", "ascii_fold", "english_basic"])
@pytest.mark.parametrize("length", ["analyzed", "default"])
def test_batches_rank_as_the_join_of_postings_does(spark, texts, asked, monkeypatch, analyzer, length):
    monkeypatch.setattr(batch, "CELLS", 100)
    monkeypatch.setattr(batch, "PARTS", 50)
    got = rows(search.bm25_batch(texts, "doc_id", "text", asked, 7, analyzer, length))
    monkeypatch.setattr(batch, "RESULTS", 0)
    assert got and got == rows(search.bm25_batch(texts, "doc_id", "text", asked, 7, analyzer, length))


def test_batches_in_one_pass_rank_as_each_alone(spark, texts, asked):
    for analyzer, df in search.bm25_batches(texts, "doc_id", "text", asked, 5, ("default", "ascii_fold", "english_basic")).items():
        assert rows(df) == rows(search.bm25_batch(texts, "doc_id", "text", asked, 5, analyzer))


def test_no_more_than_k_rows_of_each_query_leave_a_task():
    held = batch._Best(2, 3)
    for at in range(0, 1000, 10):
        held.add(pa.array(range(at, at + 10)), np.ones((2, 10)))  # all are equal: the least keys count
    assert held.cut().column("key").to_pylist() == [0, 1, 2] * 2


def test_ranking_shuffles_no_pairs_of_query_and_text(spark, texts, asked, monkeypatch):
    """Its input to the ranking is ``k`` rows of each query and task, where postings joined with queries had thousands."""
    made = []
    monkeypatch.setattr(batch, "cut", lambda df: made.append(search.cut(df)) or made[-1])
    ranked = search.bm25_batch(texts, "doc_id", "text", asked, 2)
    tasks = made[0].rdd.getNumPartitions()
    assert len(made) == 2 and ranked.count() == 24 and made[0].count() == 340
    assert tasks * 12 * 2 < 340  # texts kept once, whatever the number of queries


def test_terms_are_mapped_alike_in_python_and_columns(spark):
    words = [w.lower() for w in WORDS] + ["zes", "ses", "axes", "shes", "ties", "aties", "ies", "bus", "pass", "news", "dogs", "a1s", "niños", "łódź", "straßenes", "ægis"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", *[T.map_terms(F.array("w"), a).alias(a) for a in ("ascii_fold", "english_basic")]).collect()
    for r in got:
        assert r["ascii_fold"] == [T.query_fold(r["w"])]
        assert r["english_basic"] == [x for x in [batch._english(r["w"])] if x is not None]


def test_rows_of_one_key_are_one_text(spark, asked):
    parted = spark.createDataFrame([(1, "the box"), (1, "the apples the"), (2, "apples")], "doc_id bigint, text string")
    whole = spark.createDataFrame([(1, "the box the apples the"), (2, "apples")], "doc_id bigint, text string")
    got, want = (rows(search.bm25_batch(df, "doc_id", "text", asked, 5)) for df in (parted, whole))
    assert got and got == want


def test_measures_by_class_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    ranking = spark.createDataFrame([(q, d, r + 1) for q in range(9) for r, d in enumerate(rng.sample(range(60), 8))], "query_id bigint, doc_id bigint, rank bigint")
    judged = spark.createDataFrame([(d % 4, d, d % 5 - 1) for d in range(60) if d % 4 != 3], "class bigint, doc_id bigint, grade int")
    classed = ranking.select("query_id", (F.col("query_id") % 4).alias("class"))
    pairs = classed.distinct().join(judged, "class").drop("class")

    def plain(df):
        return sorted([round(x, 9) for x in r] for r in df.collect())

    got = plain(relevance.evaluate_classes(ranking, classed, judged, 5))
    assert got == plain(relevance.evaluate(ranking, pairs, 5)) and len(got) == 7
    ideal = {q: sorted((2**g - 1 for _, d, g in ((x["class"], x["doc_id"], x["grade"]) for x in judged.collect()) if d % 4 == q % 4 and g > 0), reverse=True)[:5] for q in range(9)}
    tops = {}
    for r in ranking.collect():
        if r["rank"] <= 5 and r["doc_id"] % 4 == r["query_id"] % 4 and (g := r["doc_id"] % 5 - 1) > 0:
            tops[r["query_id"]] = tops.get(r["query_id"], 0) + (2**g - 1) / math.log2(r["rank"] + 1)
    for r in relevance.evaluate_classes(ranking, classed, judged, 5).collect():
        q = r["query_id"]
        assert r["ndcg"] == pytest.approx(tops.get(q, 0) / sum(g / math.log2(p + 2) for p, g in enumerate(ideal[q])))
