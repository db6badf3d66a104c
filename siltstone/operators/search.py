"""Ranked full text: boolean and term-frequency search, BM25, keyword search, postings and statistics.

With a stored index (``sources.text_index``) a query reads the postings of its terms and nothing else.
Without one, term counts and the length of each document come from one pass over the texts, in which
only fixed-size numbers leave the scan; they are written once and read by statistics and ranking.
Statistics are those of the whole collection, whatever is filtered later. Batches of queries are scored
beside the texts (``operators.batch``); only those too large for that go through postings, joined on the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import batch
from siltstone.sources.files import cut
from siltstone.sources.text_index import TextIndex, Texts, dealt, runs, tokenized

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def weight(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def counts(df: DataFrame, key: str, column: str, terms: list[str], analyzer: str, length: str = "default") -> DataFrame:
    """(key, dl, tf): length of each text and how often it has each of the terms; texts without tokens are left out."""
    own = T.tokens(F.col(column)) if analyzer == "default" or length == "default" else T.terms(F.col(column), analyzer)
    # exploding an array of one keeps Catalyst from splitting the text again for each use
    split = dealt(df.select(*dict.fromkeys((key, column)))).select(F.col(key), F.explode(F.array(own)).alias("own"))
    split = split.select(key, F.size("own").alias("dl"), F.explode(F.array(F.col("own") if analyzer == "default" or length != "default" else T.map_terms(F.col("own"), analyzer))).alias("mapped"))

    def times(term: str) -> Column:
        return F.size("mapped") - F.size(F.array_remove("mapped", term))

    return split.filter("dl > 0").select(key, "dl", F.array(*[times(t) for t in terms]).alias("tf"))


def bm25(df: DataFrame, key: str, column: str, query: str, require_all: bool = False, k1: float = K1, b: float = B, analyzer: str = "default", length: str = "default") -> DataFrame:
    """(key, score) of the texts that have any, or all, of the query's terms."""
    terms = T.query_terms(query, analyzer)
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    found = cut(counts(df, key, column, terms, analyzer, length))
    stats = found.agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.sum("dl") / F.count(F.lit(1)), F.lit(1.0)).alias("mean"),
        F.array(*[F.sum((F.col("tf")[i] > 0).cast("bigint")) for i in range(len(terms))]).alias("df"),
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col("tf")[i]
        score = score + F.when(tf > 0, idf(F.col("n"), F.col("df")[i]) * weight(tf, F.col("dl"), F.col("mean"), k1, b)).otherwise(0.0)
    hit = F.array_min("tf") > 0 if require_all else F.array_max("tf") > 0
    return found.filter(hit).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # one row


def term_frequency(df: DataFrame, key: str, column: str, query: str, analyzer: str = "default") -> DataFrame:
    """(key, score): texts that have all terms of the query, scored by how often."""
    terms = T.query_terms(query, analyzer)
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    found = counts(df, key, column, terms, analyzer)
    return found.filter(F.array_min("tf") > 0).select(key, F.aggregate("tf", F.lit(0), lambda a, x: a + x).cast("double").alias("score"))


def keyword(df: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """(key, score = 1): texts that are the query, but for case and what isn't a letter or digit."""
    term = "".join(T.query_tokens(query))
    wanted = F.array(*[F.lit(t) for t in T.query_terms(query)])
    same = (T.keyword_term(F.col(column)) == F.lit(term)) & (F.size(F.array_except(wanted, T.tokens(F.col(column)))) == 0)
    return df.filter(same).select(key, F.lit(1.0).alias("score"))


# --------------------------------------------------------------------------- by a stored index

#: Stored terms that a query's terms may stand for and still be named one by one in the scan; beyond, they are joined.
NAMED = 1000


def _postings_of(index: TextIndex, terms: list[str], analyzer: str) -> DataFrame:
    """(term, key, tf, dl) of the query's terms; those of other analyzers from the default terms that they are made of."""
    if analyzer == "default":
        return index.postings.filter(F.col("term").isin(terms))
    mapped = T.map_terms(F.array("term"), analyzer)
    same = index.vocabulary.select("term", F.explode(mapped).alias("mapped")).filter(F.col("mapped").isin(terms))
    few = same.limit(NAMED + 1).collect()
    if len(few) > NAMED:
        made = index.postings.join(same, "term")
    elif not few:
        return index.postings.limit(0)
    else:
        name = F.lit(None).cast("string")
        for r in few:
            name = F.when(F.col("term") == r["term"], r["mapped"]).otherwise(name) if len(few) <= 64 else name
        made = index.postings.filter(F.col("term").isin([r["term"] for r in few]))
        made = made.withColumn("mapped", name) if len(few) <= 64 else made.join(F.broadcast(same), "term")  # at most NAMED rows
    return made.groupBy("mapped", index.key).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")).withColumnRenamed("mapped", "term")


def indexed(index: TextIndex, query: str, rank: str = "bm25", require_all: bool = False, k1: float = K1, b: float = B, analyzer: str = "default") -> DataFrame:
    """(key, score) as ``bm25`` and ``term_frequency`` have it, from the postings of the query's terms."""
    terms = T.query_terms(query, analyzer)
    if not terms:
        return index.lengths.select(index.key, F.lit(0.0).alias("score")).limit(0)
    found = _postings_of(index, terms, analyzer)
    if rank == "term_frequency":
        return found.groupBy(index.key).agg(F.sum("tf").cast("double").alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms)).select(index.key, "score")
    if analyzer == "default":
        df = dict(index.vocabulary.filter(F.col("term").isin(terms)).select("term", "df").collect())
    else:
        df = dict(found.groupBy("term").count().collect())
    if require_all and len(df) < len(terms) or not df:
        return index.lengths.select(index.key, F.lit(0.0).alias("score")).limit(0)
    inverse = F.lit(0.0)
    for term, n in df.items():
        inverse = F.when(F.col("term") == term, idf(F.lit(float(index.documents)), F.lit(float(n)))).otherwise(inverse)
    part = inverse * weight(F.col("tf"), F.col("dl"), F.lit(index.mean), k1, b)
    scored = found.groupBy(index.key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n"))
    return (scored.filter(F.col("n") == len(terms)) if require_all else scored).select(index.key, "score")


def candidates(df: DataFrame, key: str, clause: dict, scoped: bool = False, index: TextIndex | Texts | None = None) -> DataFrame:
    """(key, score) of a text_search clause. Aggregates (``scoped``) always use the default analyzer."""
    if isinstance(index, Texts):
        df, index = index.df, None
    analyzer = "default" if scoped else T.resolve(clause.get("analyzer"))
    if analyzer == "keyword":
        if index is not None:  # texts that have all of its tokens are few
            df = df.join(indexed(index, clause["query"], "term_frequency").select(key), key, "left_semi")
        return cut(keyword(df, key, clause["field"], clause["query"]))  # few, and read by sampling, ordering and counting
    if index is not None:
        return indexed(index, clause["query"], clause.get("rank", "bm25"), clause.get("operator", "or") == "and", clause.get("k1", K1), clause.get("b", B), analyzer)
    if clause.get("rank", "bm25") == "term_frequency":
        return term_frequency(df, key, clause["field"], clause["query"], analyzer)
    return bm25(df, key, clause["field"], clause["query"], clause.get("operator", "or") == "and", clause.get("k1", K1), clause.get("b", B), analyzer)


# --------------------------------------------------------------------------- postings


def postings(df: DataFrame, key: str, column: str, analyzer: str = "default") -> DataFrame:
    """(term, key, tf), counted within the rows."""
    return runs(tokenized(df, key, column, analyzer), key).select("term", key, "tf")


def lengths(df: DataFrame, key: str, column: str, analyzer: str = "default") -> DataFrame:
    """(key, dl) of the texts that have tokens."""
    return df.select(key, F.size(T.terms(F.col(column), analyzer)).alias("dl")).filter("dl > 0")


def statistics(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row: documents with tokens, distinct terms, mean length."""
    terms = df.select(F.explode(T.tokens(F.col(column))).alias("term")).agg(F.count_distinct("term").alias("distinct_terms"))
    sizes = lengths(df, key, column).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("dl"), 6).alias("avg_doc_len"))
    return sizes.crossJoin(F.broadcast(terms))  # one row each


def bm25_batch(
    df: DataFrame, key: str, column: str, queries: DataFrame, k: int, analyzer: str = "default", length: str = "analyzed", k1: float = K1, b: float = B, index: TextIndex | None = None
) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` of each query (query_id, text), all queries in one job."""
    found = None if analyzer == "keyword" else batch.best(df, key, column, queries, k, (analyzer,), length, k1, b)
    if found is not None:
        return found[analyzer]
    words = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text"), analyzer))).alias("term"))
    wanted = words.select("term").distinct()
    if index is not None:
        post, n, mean = _batch_postings(index, wanted, analyzer, length)
        n, mean = F.lit(float(n)), F.lit(mean)
    else:
        own = T.terms(F.col(column), analyzer)
        sized = own if length == "analyzed" else T.tokens(F.col(column))
        split = cut(
            df.select(key, F.explode(F.array(F.struct(own.alias("own"), F.size(sized).alias("dl")))).alias("x")).select(key, "x.dl", F.explode_outer("x.own").alias("term"))
            .groupBy("term", key, "dl").agg(F.count("term").alias("tf"))
        )  # one pass over the texts; a text without terms has a row without one
        n, mean = split.select(key, "dl").filter("dl > 0").distinct().agg(F.count(F.lit(1)), F.greatest(F.avg("dl"), F.lit(1.0))).first()
        n, mean = F.lit(float(n)), F.lit(float(mean or 1.0))
        # terms nobody asks for are dropped before anything is joined
        post = split.join(wanted, "term", "left_semi")
    counted = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = words.join(counted, "term")  # as many rows as the queries have terms
    part = idf(n, F.col("df")) * weight(F.col("tf"), F.col("dl"), mean, k1, b)
    sums = post.join(asked, "term").select("query_id", key, part.alias("part")).groupBy("query_id", key).agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def bm25_batches(df: DataFrame, key: str, column: str, queries: DataFrame, k: int, analyzers: tuple[str, ...]) -> dict[str, DataFrame]:
    """``bm25_batch`` by analyzer, in one pass over the texts where the batch allows."""
    found = None if "keyword" in analyzers else batch.best(df, key, column, queries, k, analyzers, "analyzed", K1, B)
    return found or {a: bm25_batch(df, key, column, queries, k, a) for a in analyzers}


def _batch_postings(index: TextIndex, wanted: DataFrame, analyzer: str, length: str) -> tuple[DataFrame, int, float]:
    """((term, key, tf, dl) of the wanted terms, documents, mean length), from stored postings."""
    key = index.key
    if analyzer == "default":
        return index.postings.join(wanted, "term", "left_semi"), index.documents, index.mean
    same = index.vocabulary.select("term", F.explode(T.map_terms(F.array("term"), analyzer)).alias("mapped")).join(wanted.withColumnRenamed("term", "mapped"), "mapped", "left_semi")
    post = index.postings.join(same, "term").groupBy("mapped", key).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")).withColumnRenamed("mapped", "term")
    if analyzer != "english_basic" or length != "analyzed":
        return post, index.documents, index.mean
    # its lengths are without stop words
    stop = index.postings.filter(F.col("term").isin(sorted(T.STOPWORDS))).groupBy(key).agg(F.sum("tf").alias("stop"))
    sizes = cut(index.lengths.join(stop, key, "left").select(key, (F.col("dl") - F.coalesce("stop", F.lit(0))).alias("own")).filter("own > 0"))
    n, mean = sizes.agg(F.count(F.lit(1)), F.greatest(F.avg("own"), F.lit(1.0))).first()
    return post.drop("dl").join(sizes, key).withColumnRenamed("own", "dl"), n, float(mean or 1.0)
