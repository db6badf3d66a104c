"""BM25 of a batch of queries, scored in the tasks that hold the texts.

Nearly every text has a term of nearly every query, so that pairs of query and text are the product of
both and can't be shuffled. One pass over the texts keeps, for each, the terms that any query asks for
(numbers and counts, written once); document frequencies and lengths are added up from these. Then each
task scores its texts against all queries and gives no more than the best ``k`` of each, so that what is
shuffled grows with tasks, queries and ``k``. Nothing is left out: a text that isn't among the best of its
task isn't among the best of all. Ties are cut by the key, as in the ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siltstone.functions import text as T
from siltstone.sources.files import cut
from siltstone.sources.text_index import tokenized

#: Queries, pairs of query and term, and results (queries times k) up to which a batch is scored in this way.
QUERIES, WORDS, RESULTS = 10_000, 500_000, 200_000
#: Scores that a task holds at once.
CELLS = 2_000_000


def best(df: DataFrame, key: str, column: str, queries: DataFrame, k: int, analyzers: tuple[str, ...], length: str, k1: float, b: float) -> dict[str, DataFrame] | None:
    """(query_id, key, score, rank) by analyzer, from one pass over the texts; None where the batch is too large."""
    spark = df.sparkSession
    ids, numbers, wanted, asked = [], {}, [], []
    for analyzer in analyzers:
        words = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text"), analyzer))).alias("term")).distinct()
        pairs = words.orderBy("query_id", "term").limit(WORDS + 1).collect()
        terms: dict[str, int] = {}
        for r in pairs:
            if r["query_id"] not in numbers:
                numbers[r["query_id"]] = len(ids)
                ids.append(r["query_id"])
        if len(pairs) > WORDS or len(ids) > QUERIES or len(ids) * k > RESULTS:
            return None
        asked.append([(terms.setdefault(r["term"], len(terms)), numbers[r["query_id"]]) for r in pairs])
        wanted.append(terms)
    kind = df.schema[key]
    fields = ", ".join(("analyzer int", "dl int", "terms array<int>", "tfs array<int>"))
    of_texts = StructType([kind, *StructType.fromDDL(fields)])
    found = cut(tokenized(df, key, column).mapInArrow(lambda it: _counted(it, kind.name, analyzers, wanted, length == "analyzed"), of_texts))
    sizes = {r["analyzer"]: (float(r["n"]), max(1.0, r["mean"])) for r in found.groupBy("analyzer").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).collect()}
    often = [np.zeros(len(terms)) for terms in wanted]
    for r in found.select("analyzer", F.explode("terms").alias("term")).groupBy("analyzer", "term").count().collect():
        often[r["analyzer"]][r["term"]] = r["count"]
    scorers = []
    for i, pairs in enumerate(asked):
        n, mean = sizes.get(i, (0.0, 1.0))
        scorers.append((_lists(pairs, len(wanted[i])), np.log((n - often[i] + 0.5) / (often[i] + 0.5) + 1), mean))
    scored = StructType([*StructType.fromDDL("analyzer int, query int"), kind, StructField("score", StructType.fromDDL("x double")[0].dataType)])
    top = found.mapInArrow(lambda it: _scored(it, kind.name, scorers, len(ids), k, k1, b), scored)
    order = Window.partitionBy("analyzer", "query").orderBy(F.round("score", 9).desc(), key)
    named = spark.createDataFrame(list(enumerate(ids)), StructType([*StructType.fromDDL("query int"), StructField("query_id", queries.schema["query_id"].dataType)]))
    top = top.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    top = cut(top.join(F.broadcast(named), "query").select("analyzer", "query_id", key, "score", "rank"))  # at most RESULTS rows for each analyzer
    return {a: top.filter(F.col("analyzer") == i).drop("analyzer") for i, a in enumerate(analyzers)}


def _lists(pairs: list[tuple[int, int]], terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the queries of each term begin, queries by term)."""
    made = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.concatenate(([0], np.cumsum(np.bincount(made[:, 0], minlength=terms)))), made[:, 1]


def _english(term: str) -> str | None:
    return None if term in T.STOPWORDS else T.query_plural(term)


def _counted(batches: Iterator[pa.RecordBatch], key: str, analyzers: tuple[str, ...], wanted: list[dict[str, int]], analyzed: bool) -> Iterator[pa.RecordBatch]:
    """(key, analyzer, dl, terms, tfs) of the texts that have tokens: the wanted terms that are in each, ascending."""
    for b in batches:
        own = b.column(1)
        sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = np.repeat(np.arange(len(own)), sizes)
        coded = own.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        for i, (analyzer, terms) in enumerate(zip(analyzers, wanted, strict=True)):
            change = {"ascii_fold": T.query_fold, "english_basic": _english}.get(analyzer, lambda x: x)
            mapped = [change(w) for w in words]
            number = np.array([terms.get(w, -1) for w in mapped], np.int64)
            dl = sizes
            if analyzer == "english_basic" and analyzed and words:
                stop = np.array([w is None for w in mapped])
                dl = sizes - np.bincount(texts[stop[codes]], minlength=len(own))
            of = number[codes] if words else np.zeros(0, np.int64)
            there = of >= 0
            several, tfs = np.unique(texts[there] * max(1, len(terms)) + of[there], return_counts=True)
            at, which = several // max(1, len(terms)), several % max(1, len(terms))
            ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(own))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (which, tfs)]
            made = pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(own), i, np.int32)), pa.array(dl.astype(np.int32)), *lists], [key, "analyzer", "dl", "terms", "tfs"])
            yield made.filter(pa.array(dl > 0))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], key: str, scorers: list, queries: int, k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(analyzer, query, key, score) of the best ``k`` of each query in these texts."""
    held = [_Best(queries, k) for _ in scorers]
    rows = max(1, CELLS // max(1, queries))
    for whole in batches:
        for i, (lists, idf, mean) in enumerate(scorers):
            mine = whole.filter(pc.equal(whole.column(1), i))
            for at in range(0, len(mine), rows):
                part = mine.slice(at, rows)
                held[i].add(part.column(0), _scores(part, lists, idf, mean, queries, k1, b))
    for i, one in enumerate(held):
        if (t := one.cut()) is not None:
            for made in t.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made), i, np.int32)), made.column("query"), made.column("key"), made.column("score")], ["analyzer", "query", key, "score"])


#: Parts of scores that are added up at once.
PARTS = 2_000_000


def _scores(part: pa.RecordBatch, lists: tuple[np.ndarray, np.ndarray], idf: np.ndarray, mean: float, queries: int, k1: float, b: float) -> np.ndarray:
    """Scores by query and text."""
    n, (starts, of) = len(part), lists
    terms, tf = _flat(part.column(3)), _flat(part.column(4))
    texts = np.repeat(np.arange(n), pc.list_value_length(part.column(3)).to_numpy(zero_copy_only=False))
    dl = part.column(2).to_numpy(zero_copy_only=False)[texts]
    each = idf[terms] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)))
    times = starts[terms + 1] - starts[terms]
    ends = np.cumsum(times)
    out, begin = np.zeros(queries * n), 0
    while begin < len(terms):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PARTS, "right")))
        x = slice(begin, end)
        place = np.arange(ends[end - 1] - done) + np.repeat(starts[terms[x]] - (ends[x] - times[x] - done), times[x])
        out += np.bincount(of[place] * n + np.repeat(texts[x], times[x]), np.repeat(each[x], times[x]), queries * n)
        begin = end
    return out.reshape(queries, n)


class _Best:
    """The best ``k`` of each query so far, by rounded score and key, and some more that may be."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.parts, self.size, self.most = k, np.full(queries, -1.0), [], 0, max(100_000, 2 * queries * k)

    def add(self, keys: pa.Array, scores: np.ndarray) -> None:
        rounded = np.floor(scores * 1e9 + 0.5)
        n = scores.shape[1]
        if n > self.k:
            self.least = np.maximum(self.least, np.partition(rounded, n - self.k, axis=1)[:, n - self.k])
        q, at = np.nonzero((scores > 0) & (rounded >= self.least[:, None]))
        if len(q):
            self.parts.append(pa.table({"query": pa.array(q.astype(np.int32)), "rounded": rounded[q, at], "key": keys.take(pa.array(at)), "score": scores[q, at]}))
            self.size += len(q)
        if self.size > self.most:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        t = pa.concat_tables(self.parts)
        t = t.take(pc.sort_indices(t, [("query", "ascending"), ("rounded", "descending"), ("key", "ascending")], null_placement="at_start"))
        q = t.column("query").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = t.column("rounded").to_numpy()[last]
        t = t.filter(pa.array(place < self.k)).combine_chunks()
        self.parts, self.size = [t], len(t)
        return t
