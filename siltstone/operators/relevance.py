"""Relevance of rankings against judgments: MRR, recall, DCG and NDCG, for all queries in one job."""

from __future__ import annotations

import math
import statistics
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import invalid
from siltstone.operators import nearest, search
from siltstone.sources.files import cut
from siltstone.sources.text_index import TextIndex

RELEVANT = 1


def gain(grade, rank):
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def evaluate(ranking: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query_id, mrr, recall, dcg, ndcg) at ``k`` of each query that has a relevant document.

    ``ranking`` is (query_id, doc_id, rank) with ranks from 1, ``judged`` (query_id, doc_id, grade).
    The ideal ranking has all judged documents, whether retrieved or not.
    """
    positive = judged.filter(F.col("grade") > 0)
    return _measures(_ideal(positive.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n")), k), _top(ranking, k).join(positive, ["query_id", "doc_id"]))


def evaluate_classes(ranking: DataFrame, queries: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """As ``evaluate``, where ``judged`` (class, doc_id, grade) holds for each query (query_id, class) of its class.

    Pairs of query and judged document aren't made: the ideal of a class comes from how many have each grade.
    """
    positive, queries = judged.filter(F.col("grade") > 0), queries.distinct()
    sizes = positive.groupBy("class", "grade").agg(F.count(F.lit(1)).alias("n")).join(queries, "class").drop("class")
    return _measures(_ideal(sizes, k), _top(ranking, k).join(queries, "query_id").join(positive, ["class", "doc_id"]))


def _top(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def _ideal(sizes: DataFrame, k: int) -> DataFrame:
    """(query_id, relevant, idcg) from the judged documents of each grade (query_id, grade, n): places depend on grades alone."""
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = F.sequence(F.col("upto") - F.col("n") + 1, F.least("upto", F.lit(k)))
    gains = F.when(F.col("upto") - F.col("n") < k, F.aggregate(places, F.lit(0.0), lambda a, p: a + gain(F.col("grade"), p)))
    return (
        sizes.withColumn("upto", upto).groupBy("query_id")
        .agg(F.sum(F.when(F.col("grade") >= RELEVANT, F.col("n")).otherwise(0)).alias("relevant"), F.sum(gains).alias("idcg"))
        .filter("relevant > 0")
    )


def _measures(ideal: DataFrame, hits: DataFrame) -> DataFrame:
    found = (
        hits.groupBy("query_id")
        .agg(
            F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank"))).alias("first"),
            F.sum((F.col("grade") >= RELEVANT).cast("bigint")).alias("hits"),
            F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"),
        )
    )
    zero = F.lit(0.0)
    return ideal.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("hits") / F.col("relevant"), zero).alias("recall"),
        F.coalesce("dcg", zero).alias("dcg"),
        F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg") / F.col("idcg"), zero)).otherwise(zero).alias("ndcg"),
    )


def evaluate_all(ranking: DataFrame, queries: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """As ``evaluate``, where the documents of ``relevant`` (doc_id) are relevant, by grade 1, to every query (query_id)."""
    n = relevant.select("doc_id").distinct().count()
    if not n:
        return evaluate(ranking, queries.select("query_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("grade")), k)
    hits = ranking.filter(F.col("rank") <= k).join(relevant.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", "doc_id", F.lit(1).alias("grade"), "rank")
    best = sum(1 / math.log2(place + 1) for place in range(1, min(k, n) + 1))
    found = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("hits"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    zero = F.lit(0.0)
    return queries.select("query_id").distinct().join(found, "query_id", "left").select(
        "query_id", F.coalesce(1.0 / F.col("first"), zero).alias("mrr"), F.coalesce(F.col("hits") / n, zero).alias("recall"), F.coalesce("dcg", zero).alias("dcg"), F.coalesce(F.col("dcg") / best, zero).alias("ndcg"),
    )


def search_eval(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, k: int, mode: str = "bm25", analyzer: str = "default", index: TextIndex | None = None) -> dict:
    """Mean measures of a relevance set: {mode, per_query, macro, warnings}; each in one job over all queries.

    ``corpus`` is (doc_id, text, vector), ``queries`` (query_id, text, vector), ``qrels`` (query_id, doc_id,
    grade). Modes: bm25, vector_exact (cosine), and hybrid, half of each after scaling both lists of a query
    to 0..1. Queries without a relevant document are left out of the means, and named.
    """
    if mode not in ("bm25", "vector_exact", "hybrid"):
        raise invalid(f"unknown mode '{mode}'")
    parts = {}
    pool = k if mode != "hybrid" else 4 * k
    if mode != "vector_exact":
        parts["text"] = search.bm25_batch(corpus, "doc_id", "text", queries.select("query_id", "text"), pool if mode == "bm25" else 1 << 30, analyzer, index=index)
    if mode != "bm25":
        asked = queries.filter(F.col("vector").isNotNull()).select(F.col("query_id").alias("id"), "vector")
        parts["vector"] = nearest.every(corpus.select("doc_id", "vector"), "doc_id", "vector", pool, queries=asked.withColumnRenamed("id", "doc_id"))
    if mode == "hybrid":
        lists = None
        for part in parts.values():
            low, high = F.min("score").over(Window.partitionBy("query_id")), F.max("score").over(Window.partitionBy("query_id"))
            one = part.withColumn("low", low).withColumn("high", high).select("query_id", "doc_id", F.when(F.col("high") - F.col("low") < 1e-9, 1.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).alias("s"))
            lists = one if lists is None else lists.unionByName(one)
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
        ranking = lists.groupBy("query_id", "doc_id").agg((F.sum("s") / 2).alias("score")).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    else:
        ranking = next(iter(parts.values()))
    per_query = cut(evaluate(ranking, qrels, k))
    warnings = []
    for what, rows in (
        ("queries without a relevant judgment", queries.join(per_query, "query_id", "left_anti")),
        ("judgments of unknown documents", qrels.join(corpus, "doc_id", "left_anti")),
        ("judgments of unknown queries", qrels.join(queries, "query_id", "left_anti")),
        ("queries without a vector", queries.filter(F.col("vector").isNull()) if mode != "bm25" else None),
    ):
        if rows is not None and (n := rows.count()):
            warnings.append(f"{n} {what}")
    if per_query.isEmpty():
        warnings.append("no query has a relevant judgment: all measures are 0")
    return {"mode": mode, "analyzer": analyzer, "per_query": per_query, "macro": macro(per_query), "warnings": warnings}


def vector_eval(df: DataFrame, key: str, column: str, cells: nearest.Cells, queries: list[list[float]], k: int, metric: str | None = None) -> dict:
    """Recall of the cells against exact search, mean and least over the queries, and the median time of each."""
    recalls, took = [], {"exact": [], "approximate": []}
    for q in queries:
        ids = {}
        for name, run in (("exact", lambda: nearest.exact(df, key, column, q, k, metric)), ("approximate", lambda: cells.search(key, column, q, k, metric))):  # noqa: B023
            begin = time.perf_counter()
            ids[name] = {r[0] for r in run().select(key).collect()}
            took[name].append(time.perf_counter() - begin)
        recalls.append(len(ids["exact"] & ids["approximate"]) / max(1, len(ids["exact"])))
    return {"queries": len(queries), "mean_recall": sum(recalls) / max(1, len(recalls)), "min_recall": min(recalls, default=0.0), **{f"{n}_p50_ms": round(1e3 * statistics.median(t), 3) if t else None for n, t in took.items()}}


def macro(per_query: DataFrame) -> DataFrame:
    """Means over queries, rounded."""
    names = ("mrr", "recall", "ndcg")
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def searchable(title: str, body: str, tags: str, category: str):
    """The text of a corpus entry: its parts that aren't empty, with spaces between them."""
    parts = [F.nullif(F.col(title), F.lit("")), F.nullif(F.col(body), F.lit("")), F.nullif(F.array_join(tags, " "), F.lit("")), F.nullif(F.col(category), F.lit(""))]
    return F.concat_ws(" ", *parts)


def recall_of(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact results that the approximate ones have."""
    hits = exact.join(approximate.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
