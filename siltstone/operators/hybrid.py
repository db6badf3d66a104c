"""Fusion of text and vector rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import nearest, search
from siltstone.sources.files import cut
from siltstone.sources.text_index import TextIndex

RRF = 60
POOL = 4
#: Vectors of a pool that go through the driver.
FEW = 10_000


def fused(df: DataFrame, key: str, h: dict, index: TextIndex | None = None) -> DataFrame:
    """(key, score, text_score, vector_score) of all texts that match and the nearest ``POOL * top_k`` vectors."""
    analyzer = T.resolve(h.get("analyzer"))
    clause = {"field": h["text_field"], "query": h["text_query"], **{x: h[x] for x in ("operator", "k1", "b") if h.get(x) is not None}, "analyzer": analyzer}
    text = search.candidates(df, key, clause, index=index).withColumnRenamed("score", "text_score")
    vector = nearest.exact(df, key, h["vector_field"], h["vector"], POOL * h["top_k"], h.get("metric")).withColumnRenamed("score", "vector_score")
    if POOL * h["top_k"] <= FEW:  # a list of known length, that is read several times
        vector = df.sparkSession.createDataFrame(vector.collect(), vector.schema)
    weights = h.get("weights") or {}
    wt, wv = float(weights.get("text", 0.5)), float(weights.get("vector", 0.5))
    if h.get("fusion", "weighted_sum") == "reciprocal_rank_fusion":
        text = ranked(text, key, "text_score", "text_rank")
        vector = vector.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.round("vector_score", 9).desc(), key)))
        both = text.join(vector, key, "full_outer")
        score = F.coalesce(wt / (RRF + F.col("text_rank")), F.lit(0.0)) + F.coalesce(wv / (RRF + F.col("vector_rank")), F.lit(0.0))
        return both.select(key, score.alias("score"), "text_score", "vector_score")
    range_t = text.agg(F.min("text_score").alias("t0"), F.max("text_score").alias("t1"))
    range_v = vector.agg(F.min("vector_score").alias("v0"), F.max("vector_score").alias("v1"))

    def scaled(x: str, low: str, high: str):
        return F.when(F.col(x).isNull(), 0.0).when(F.col(high) - F.col(low) < 1e-9, 1.0).otherwise((F.col(x) - F.col(low)) / (F.col(high) - F.col(low)))

    both = text.join(vector, key, "full_outer").crossJoin(F.broadcast(range_t)).crossJoin(F.broadcast(range_v))  # one row each
    return both.select(key, (wt * scaled("text_score", "t0", "t1") + wv * scaled("vector_score", "v0", "v1")).alias("score"), "text_score", "vector_score")


def ranked(df: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """``df`` with the rank by score, ties by key: a sort by ranges, no task ranks more than its own."""
    return numbered(df.orderBy(F.round(score, 9).desc(), key).withColumn("place", F.monotonically_increasing_id()), "place", name)


def numbered(df: DataFrame, place: str, name: str) -> DataFrame:
    """``df``, whose rows have their place (by partition and row) in a column, with their numbers from 1 instead.

    The driver only adds up how many rows the partitions before have.
    """
    placed, part = cut(df), F.shiftright(place, 33)
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    within = F.col(place).bitwiseAND((1 << 33) - 1) + 1
    offset = F.get(F.array(*[F.lit(n).cast("bigint") for n in before]) if before else F.array().cast("array<bigint>"), part.cast("int"))
    return placed.withColumn(name, (offset + within).cast("bigint")).drop(place)
