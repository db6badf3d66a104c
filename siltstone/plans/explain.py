"""EXPLAIN: the plan tree of a request, its strategy, and, on request, what was counted in running it."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.operators import find as F_find
from siltstone.plans.catalog import Schema
from siltstone.plans.ir import Find
from siltstone.sources.text_index import TextIndex

LARGE = 10_000
CAPABILITIES = tuple(sorted(
    "find count exists aggregate search_page insert bulk_insert update delete upsert transactions snapshots facets groups metrics includes full_text bm25 "
    "analyzers snippets vectors approximate_vectors hybrid cursors explain migration_estimate dump_restore garbage_collection".split()
))


def conjuncts(node: dict | None) -> list[dict]:
    if node is None:
        return []
    return [c for n in node["filters"] for c in conjuncts(n)] if node["type"] == "and" else [node]


def access(q: Find, schema: Schema, rows: int, distinct: dict[str, int]) -> tuple[str, str, int]:
    """(node, strategy, estimated rows): ranked clauses decide; else the cheapest index among the conjuncts."""
    if q.hybrid:
        return "HybridSearch", "hybrid", rows
    if q.text_search:
        return ("FullTextBm25Search", "full_text_bm25", rows) if q.text_search.get("rank", "bm25") == "bm25" else ("FullTextIndexLookup", "full_text_scan", rows)
    if q.vector:
        return "VectorSearch", "vector_exact_scan", min(rows, q.vector["k"])
    found = [(rows, 1, "Scan", "full_scan")]
    for c in conjuncts(q.filter):
        if c["type"] == "contains_text" and c["field"] in schema.full_text:
            found.append((max(1, rows // 20), 0, "FullTextIndexLookup", "full_text_scan"))
        if c["type"] == "compare" and c["op"] == "eq":
            f = schema.field(c["field"])
            if f and (f.primary_key or f.unique):
                found.append((1, 0, "PointLookup", "index_lookup"))
            elif f and f.indexed or c["field"] in schema.document_paths:
                estimate = rows // distinct[c["field"]] if distinct.get(c["field"]) else rows // 10
                found.append((max(1, estimate), 0, "IndexLookup" if f and f.indexed else "DocumentPathIndexLookup", "index_lookup"))
    estimate, _, node, strategy = min(found)
    return node, strategy, estimate


def clauses(q: Find) -> dict[str, str]:
    """A line on each clause of a find; values of queries aren't repeated."""
    out = {}
    if q.filter:
        out["filter"] = " and ".join(f"{c.get('field', '')} {c.get('op', c['type'])}".strip() for c in conjuncts(q.filter))
    if q.text_search:
        out["text_search"] = f"{q.text_search['field']} by {q.text_search.get('rank', 'bm25')}, {q.text_search.get('operator', 'or')} of its terms, analyzer {q.text_search.get('analyzer') or 'default'}"
    if q.vector:
        out["vector"] = f"{q.vector['field']}, the nearest {q.vector['k']} by {q.vector.get('metric') or 'cosine'}"
    if q.hybrid:
        out["hybrid"] = f"{q.hybrid['text_field']} and {q.hybrid['vector_field']} by {q.hybrid.get('fusion', 'weighted_sum')}, top {q.hybrid['top_k']}"
    if q.order_by:
        out["order_by"] = ", ".join(k["field"] + (" desc" if k.get("desc") else "") for k in q.order_by)
    return out


def explain(df: DataFrame, q: Find, key: str, schema: Schema, rows: int, distinct: dict[str, int] | None = None, indexes: dict | None = None, over: str = "Find") -> dict:
    """The plan of a find, or of what is done ``over`` it: Count, Exists, SearchPage (a cursor) or Mutation."""
    node, strategy, estimate = access(q, schema, rows, distinct or {})
    fields = {q.text_search["field"]} if q.text_search else {q.hybrid["text_field"]} if q.hybrid else {c["field"] for c in conjuncts(q.filter) if c["type"] == "contains_text"}
    used = bool(fields & {f for f, x in (indexes or {}).items() if isinstance(x, TextIndex)})
    tree: dict = {"node": node, "collection": q.collection, "estimated_rows": estimate}
    for name, there in (
        ("Filter", q.filter), ("Sort", q.order_by or q.ranked), ("Offset", q.offset), ("Limit", q.limit is not None), ("Projection", q.projection is not None), ("RelationshipInclude", q.includes),
        ("Count", over == "Count"), ("Exists", over == "Exists"), ("Cursor", over == "SearchPage"), ("Mutation", over == "Mutation"),
    ):
        if there:
            tree = {"node": name, "input": tree}
    shape = hashlib.blake2b(f"{q.collection}|{strategy}|{used}".encode(), digest_size=8).hexdigest()
    warnings = [f"a scan of more than {LARGE} records"] if node == "Scan" and rows > LARGE else []
    return {"strategy": strategy, "used_index": used, "plan": tree, "estimated_rows": estimate, "clauses": clauses(q), "warnings": warnings, "plan_id": shape}


#: Why a strategy is taken.
REASONS = {
    "hybrid": "the request has a hybrid clause", "full_text_bm25": "the request ranks a text by BM25", "full_text_scan": "a text condition is the most selective",
    "vector_exact_scan": "the request asks for the nearest vectors", "index_lookup": "an indexed field is compared by equality", "full_scan": "no index fits the filter",
}


def analyze(df: DataFrame, q: Find, key: str, schema: Schema, indexes: dict | None = None) -> dict:
    """Runs the query; counts the records scanned, matched and returned as they pass."""
    scanned, matched = Observation("scanned"), Observation("matched")
    begin = time.perf_counter()
    seen = df.observe(scanned, F.count(F.lit(1)).alias("n")) if not q.ranked else df
    rows = F_find.matched(seen, q, key, schema, indexes=indexes).observe(matched, F.count(F.lit(1)).alias("n"))
    # a sort without a limit reads its input twice, once to choose ranges, and changes no count
    (rows if q.limit is None else F_find.page(rows, q, key)).write.format("noop").mode("overwrite").save()
    limit = q.limit if q.limit is not None or not q.hybrid else q.hybrid["top_k"]
    left = max(0, matched.get["n"] - (q.offset or 0))
    return {
        "scanned": df.count() if q.ranked else scanned.get["n"], "matched": matched.get["n"], "returned": left if limit is None else min(limit, left),
        "micros": int((time.perf_counter() - begin) * 1e6), "reason": REASONS[access(q, schema, 0, {})[1]],
    }


def main(args: list[str]) -> int:
    """``python -m siltstone.plans.explain REQUEST.json TABLE KEY [--analyze]``: the plan of a find, as JSON."""
    from pyspark.sql import SparkSession

    from siltstone.engine import Engine

    names = [a for a in args if a != "--analyze"]
    with open(names[0]) as f:
        request = json.load(f)
    engine = Engine(SparkSession.builder.getOrCreate())
    engine.register(request["collection"], engine.spark.read.parquet(names[1]), names[2])
    print(json.dumps(engine.explain(request, "--analyze" in args), indent=2))
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
