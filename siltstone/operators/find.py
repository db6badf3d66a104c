"""The find pipeline: candidates, filter, order, page, links, projection, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import invalid
from siltstone.functions import text as T
from siltstone.functions.snippets import snippet
from siltstone.operators import hybrid, nearest, search
from siltstone.plans.catalog import Link, Schema
from siltstone.plans.ir import Find
from siltstone.plans.predicates import Path, condition
from siltstone.sources.text_index import TextIndex

SCORES = ("score", "text_score", "vector_score")


def order(df: DataFrame, keys: list[dict], key: str) -> list[Column]:
    """Missing values are greatest: last ascending, first descending; ties by the record's key."""
    columns = [Path(df, k["field"]).column for k in keys]
    return [*(c.desc_nulls_first() if k.get("desc") else c.asc_nulls_last() for c, k in zip(columns, keys, strict=True)), df[key].asc()]


def score_order(key: str) -> list[Column]:
    return [F.round("score", 9).desc(), F.col(key).asc()]


def scores(df: DataFrame, q: Find, key: str, cells: nearest.Cells | None = None, indexes: dict[str, TextIndex] | None = None) -> DataFrame | None:
    """(key, score, text_score, vector_score) of a ranked query's candidates, from the whole collection."""
    none, indexes = F.lit(None).cast("double"), indexes or {}
    if q.text_search:
        return search.candidates(df, key, q.text_search, index=indexes.get(q.text_search["field"])).select(key, "score", F.col("score").alias("text_score"), none.alias("vector_score"))
    if q.vector:
        v = q.vector
        best = cells.search(key, v["field"], v["query"], v["k"], v.get("metric")) if cells else nearest.exact(df, key, v["field"], v["query"], v["k"], v.get("metric"))
        return best.select(key, "score", none.alias("text_score"), F.col("score").alias("vector_score"))
    if q.hybrid:
        return hybrid.fused(df, key, q.hybrid, indexes.get(q.hybrid["text_field"]))
    return None


def seed_of(node: dict | None, schema: Schema | None) -> dict | None:
    """A ``contains_text`` on an indexed field among the conjuncts: without an order, it ranks the result by term frequency."""
    if node is None or schema is None:
        return None
    if node["type"] == "contains_text" and node["field"] in schema.full_text:
        return node
    return next((s for n in node["filters"] if (s := seed_of(n, schema))), None) if node["type"] == "and" else None


def by_index(node: dict | None, indexes: dict[str, TextIndex]) -> tuple[list[dict], dict | None]:
    """(the ``contains_text`` conjuncts that a stored index answers, the rest of the filter)."""
    if node is None:
        return [], None
    if node["type"] == "contains_text" and isinstance(indexes.get(node["field"]), TextIndex) and T.query_terms(node["query"]):
        return [node], None
    if node["type"] != "and":
        return [], node
    parts = [by_index(n, indexes) for n in node["filters"]]
    rest = [r for _, r in parts if r is not None]
    return [x for found, _ in parts for x in found], {"type": "and", "filters": rest} if rest else None


def filtered(df: DataFrame, q: Find, key: str, indexes: dict[str, TextIndex] | None = None) -> DataFrame:
    """The records that pass the filter; text conditions on indexed fields by their postings."""
    texts, rest = by_index(q.filter, indexes or {})
    rows = df.filter(condition(df, rest)) if rest else df
    for node in texts:
        rows = rows.join(search.indexed(indexes[node["field"]], node["query"], "term_frequency").select(key), key, "left_semi")
    return rows


def matched(df: DataFrame, q: Find, key: str, schema: Schema | None = None, cells: nearest.Cells | None = None, indexes: dict[str, TextIndex] | None = None) -> DataFrame:
    """Filtered records, with scores where the query ranks. Filters come after candidates: k nearest first, then the filter."""
    found = scores(df, q, key, cells, indexes)
    if found is None and not q.order_by and (seed := seed_of(q.filter, schema)):
        clause = {"field": seed["field"], "query": seed["query"], "rank": "term_frequency"}
        found = search.candidates(df, key, clause, index=(indexes or {}).get(seed["field"])).select(key, "score", F.col("score").alias("text_score"), F.lit(None).cast("double").alias("vector_score"))
    rows = filtered(df, q, key, indexes)
    return rows if found is None else rows.join(found, key)


#: Rows of a page that are sent to every executor to pick their records; a longer page is joined by a shuffle.
BROADCAST_PAGE = 10_000


def best(df: DataFrame, q: Find, key: str, cells: nearest.Cells | None = None, indexes: dict[str, TextIndex] | None = None) -> DataFrame:
    """The page of a ranked query with a limit: keys and scores are ordered and cut first, then records join."""
    found = scores(df, q, key, cells, indexes)
    if q.filter:
        found = found.join(filtered(df, q, key, indexes).select(key), key, "left_semi")
    top = page(found, q, key)
    if q.projection == [] and not q.includes and not q.snippet:
        return top
    most = (q.offset or 0) + (q.limit if q.limit is not None else q.hybrid["top_k"])
    return df.join(F.broadcast(top) if most <= BROADCAST_PAGE else top, key)


def page(df: DataFrame, q: Find, key: str, start_rank: int = 0) -> DataFrame:
    """Ordered, cut to offset and limit, and ranked where there are scores."""
    ranked = "score" in df.columns and (q.ranked or not q.order_by)
    limit = q.limit if q.limit is not None or not q.hybrid else q.hybrid["top_k"]
    by = score_order(key) if ranked else order(df, q.order_by, key)
    if ranked and limit is None:
        out = hybrid.ranked(df, key, "score", "rank")
        return out.filter(F.col("rank") > q.offset).orderBy("rank") if q.offset else out.orderBy("rank")
    out = df.orderBy(*by)
    if q.offset:
        out = out.offset(q.offset)
    if limit is not None:
        out = out.limit(limit)
    if ranked:  # over no more rows than the limit
        out = out.withColumn("rank", (F.row_number().over(Window.orderBy(*score_order(key))) + F.lit(start_rank + (q.offset or 0))).cast("bigint"))
    return out


def include(df: DataFrame, link: Link, target: DataFrame, target_key: str, key: str) -> DataFrame:
    """``includes_<link>``: the linked records as an array, in the order of the link's keys; dangling keys are dropped."""
    name = f"includes_{link.name}"
    record = F.struct(*[target[c] for c in target.columns]).alias("record")
    side = target.select(target[target_key].alias("link_key"), record)
    if link.cardinality == "to_one":
        out = df.join(side, df[link.name] == side["link_key"], "left")
        return out.withColumn(name, F.when(F.col("link_key").isNull(), F.array()).otherwise(F.array("record"))).drop("link_key", "record")
    keys = df.select(df[key], F.posexplode(link.name).alias("pos", "link_key"))
    lists = keys.join(side, "link_key").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "record"))).alias("found"))
    out = df.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(F.transform("found", lambda x: x["record"]), F.array())).drop("found")


def project(df: DataFrame, q: Find, key: str) -> DataFrame:
    """Named top-level fields that are there, after the key; scores, rank, includes and snippets stay."""
    if q.projection is None:
        return df
    extra = [c for c in df.columns if c in (*SCORES, "rank") or c.startswith(("includes_", "snippet_"))]
    return df.select(*dict.fromkeys([key, *[c for c in q.projection if c in df.columns], *extra]))


def snippets(df: DataFrame, q: Find) -> DataFrame:
    if not q.snippet:
        return df
    clause = q.text_search or (q.hybrid and {"query": q.hybrid["text_query"], "analyzer": q.hybrid.get("analyzer")})
    if not clause:
        raise invalid("snippets need a text query")
    for name in q.snippet["fields"]:
        if name.startswith("_"):
            raise invalid(f"no snippets of '{name}'")
        if name in df.columns and dict(df.dtypes)[name] == "string":
            df = df.withColumn(f"snippet_{name}", snippet(F.col(name), clause["query"], T.resolve(clause.get("analyzer")), q.snippet.get("max_fragments"), q.snippet.get("fragment_chars")))
    return df


def find(
    df: DataFrame, q: Find, key: str, schema: Schema | None = None, targets: dict | None = None, cells: nearest.Cells | None = None, indexes: dict[str, TextIndex] | None = None
) -> DataFrame:
    short = q.ranked and (q.limit is not None or q.hybrid)
    if short:
        out = best(df, q, key, cells, indexes)
    else:
        rows = matched(df, q, key, schema, cells, indexes)
        lean = q.projection is not None and not (q.order_by or q.includes or q.snippet)
        out = page(project(rows, q, key) if lean else rows, q, key)  # texts that nobody asks for aren't ordered and written
    for name in q.includes:
        link, target, target_key = (targets or {}).get(name) or (None, None, None)
        if link is None:
            raise invalid(f"no link '{name}'")
        out = include(out, link, target, target_key, key)
    if short or q.includes:  # joins don't keep the order; these are the rows of the page
        out = out.orderBy("rank") if "rank" in out.columns else out.orderBy(*order(out, q.order_by, key))
    return project(snippets(out, q), q, key)
