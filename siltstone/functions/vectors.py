"""Similarity of a stored vector and a query vector, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.errors import invalid

METRICS = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot_product": "dot", "dotproduct": "dot", "dot": "dot"}
#: Up to this many dimensions a product is written out, so that it is compiled; beyond, it is folded.
UNROLLED = 256


def metric_of(name: str | None) -> str:
    if (name or "cosine") not in METRICS:
        raise invalid(f"unknown metric '{name}'")
    return METRICS[name or "cosine"]


def _sum(vector: Column, query: list[float], each, fold) -> Column:
    if len(query) <= UNROLLED:
        total = F.lit(0.0)
        for i, q in enumerate(query):
            total = total + each(F.get(vector, F.lit(i)).cast("double"), F.lit(float(q)))
        return total
    return F.aggregate(F.zip_with(vector.cast("array<double>"), F.array(*[F.lit(float(q)) for q in query]), fold), F.lit(0.0), lambda a, x: a + x)


def dot(vector: Column, query: list[float]) -> Column:
    return _sum(vector, query, lambda x, q: x * q, lambda x, q: x * q)


def similarity(vector: Column, query: list[float], metric: str) -> Column:
    """Higher is nearer: cosine (0 where a norm is 0), the negated Euclidean distance, or the dot product."""
    if metric == "euclidean":
        return -F.sqrt(_sum(vector, query, lambda x, q: (x - q) * (x - q), lambda x, q: (x - q) * (x - q)))
    if metric == "dot":
        return dot(vector, query)
    norm = math.sqrt(sum(float(q) * float(q) for q in query))
    if norm == 0:
        return F.lit(0.0)
    own = F.sqrt(_sum(vector, query, lambda x, _: x * x, lambda x, _: x * x))
    return F.when(own == 0, F.lit(0.0)).otherwise(dot(vector, query) / (own * F.lit(norm)))


def distance(score: Column, metric: str) -> Column:
    return 1 - score if metric == "cosine" else -score
