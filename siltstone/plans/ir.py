"""The query model: requests as dataclasses, read from JSON-like dicts and validated."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from typing import Any

from siltstone.errors import EngineError, invalid
from siltstone.functions.text import query_tokens, resolve
from siltstone.functions.vectors import metric_of

MOST_ROWS, MOST_TOKENS, MOST_DEPTH, MOST_DIM, MOST_WRITES = 1_000_000, 64, 64, 4096, 100_000
OPS = ("eq", "ne", "lt", "lte", "gt", "gte", "in")
FILTERS = {
    "and": {"filters"}, "or": {"filters"}, "not": {"filter"}, "compare": {"field", "op", "value"},
    "contains": {"field", "substring"}, "exists": {"field"}, "contains_text": {"field", "query"},
}


@dataclass
class Find:
    collection: str
    filter: dict | None = None
    vector: dict | None = None
    vector_ann: dict | None = None
    text_search: dict | None = None
    hybrid: dict | None = None
    order_by: list[dict] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    projection: list[str] | None = None
    includes: list[str] = field(default_factory=list)
    timeout_ms: int | None = None
    snippet: dict | None = None

    @property
    def ranked(self) -> bool:
        return any((self.vector, self.text_search, self.hybrid))


@dataclass
class Count:
    collection: str
    filter: dict | None = None


@dataclass
class Exists(Count):
    pass


@dataclass
class Aggregate:
    collection: str
    filter: dict | None = None
    text_search: dict | None = None
    facets: list[dict] = field(default_factory=list)
    metrics: list[dict] = field(default_factory=list)
    group_by: str | None = None
    group_limit: int | None = None
    timeout_ms: int | None = None


@dataclass
class SearchPage:
    find: Find
    page_size: int
    cursor: str | None = None


@dataclass
class Mutation:
    kind: str
    collection: str
    records: list[dict] = field(default_factory=list)
    filter: dict | None = None
    set: dict = field(default_factory=dict)


def _load(kind: type, data: dict, skip: tuple[str, ...] = ()):
    known = {f.name for f in fields(kind)}
    extra = set(data) - known - set(skip)
    if extra:
        raise invalid(f"unknown fields {sorted(extra)}")
    if not isinstance(data.get("collection"), str) or not data["collection"]:
        raise invalid("a collection must be named")
    return kind(**{k: v for k, v in data.items() if k in known and v is not None})


def check_filter(node: dict | None, depth: int = 1) -> None:
    if node is None:
        return
    if depth > MOST_DEPTH:
        raise EngineError("limit_exceeded", f"filters nest deeper than {MOST_DEPTH}")
    kind = node.get("type") if isinstance(node, dict) else None
    if kind not in FILTERS or set(node) - {"type"} != FILTERS[kind]:
        raise invalid(f"not a filter: {node!r:.80}")
    if kind == "compare" and node["op"] not in OPS:
        raise invalid(f"unknown operator '{node['op']}'")
    if kind == "contains_text":
        check_tokens(node["query"])
    for below in node.get("filters", [node["filter"]] if kind == "not" else []):
        check_filter(below, depth + 1)


def check_tokens(query: str) -> None:
    if len(query_tokens(query)) > MOST_TOKENS:
        raise EngineError("limit_exceeded", f"more than {MOST_TOKENS} query tokens")


def check_vector(query: list[float]) -> None:
    if not query or len(query) > MOST_DIM or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in query):
        raise invalid("a query vector must have finite numbers, and not too many")


def check_find(q: Find) -> Find:
    if sum(x is not None for x in (q.vector, q.text_search, q.hybrid)) > 1:
        raise invalid("at most one of vector, text_search and hybrid can be given")
    for name in ("limit", "offset"):
        n = getattr(q, name)
        if n is not None and (not isinstance(n, int) or n < 0):
            raise invalid(f"{name} must not be negative")
        if (n or 0) > MOST_ROWS:
            raise EngineError("limit_exceeded", f"{name} is above {MOST_ROWS}")
    check_filter(q.filter)
    if q.vector:
        check_vector(q.vector["query"])
        metric_of(q.vector.get("metric"))
    if q.vector_ann is not None:
        if not q.vector:
            raise invalid("vector_ann needs a vector clause")
        if not 1 <= q.vector_ann.get("m", 16) <= 512 or not 1 <= q.vector_ann.get("ef_construction", 200) <= 4096:
            raise invalid("m must be in 1..512 and ef_construction in 1..4096")
        if q.vector_ann.get("fallback", "exact") not in ("exact", "error"):
            raise invalid("fallback is 'exact' or 'error'")
    if q.text_search:
        check_text(q.text_search)
    if q.hybrid:
        check_hybrid(q.hybrid)
    return q


def check_text(ts: dict) -> None:
    resolve(ts.get("analyzer"))
    if ts.get("operator", "or") not in ("or", "and") or ts.get("rank", "bm25") not in ("bm25", "term_frequency"):
        raise invalid("unknown operator or rank")
    check_tokens(ts["query"])
    if not query_tokens(ts["query"]):
        raise invalid("the query has no tokens")


def check_hybrid(h: dict) -> None:
    resolve(h.get("analyzer"))
    metric_of(h.get("metric"))
    check_vector(h["vector"])
    check_tokens(h["text_query"])
    w = h.get("weights") or {}
    text, vector = w.get("text", 0.5), w.get("vector", 0.5)
    if not all(math.isfinite(x) and x >= 0 for x in (text, vector)) or text + vector == 0:
        raise invalid("weights must be finite, not negative, and not both 0")
    if h.get("top_k", 0) < 1:
        raise invalid("top_k must be 1 at least")
    if not query_tokens(h["text_query"]):
        raise invalid("the query has no tokens")
    if h.get("fusion", "weighted_sum") not in ("weighted_sum", "reciprocal_rank_fusion"):
        raise invalid("unknown fusion")


def check_aggregate(q: Aggregate) -> Aggregate:
    check_filter(q.filter)
    if not (q.facets or q.metrics or q.group_by):
        raise invalid("an aggregate needs a facet, a metric or group_by")
    for m in q.metrics:
        if m.get("op") not in ("count", "min", "max", "avg"):
            raise invalid(f"unknown metric '{m.get('op')}'")
        if m["op"] != "count" and not m.get("field"):
            raise invalid(f"{m['op']} needs a field")
    if q.group_limit is not None and (not q.group_by or q.group_limit < 1):
        raise invalid("group_limit must be 1 at least, and needs group_by")
    return q


def read_request(data: dict[str, Any]) -> Find | Count | Exists | Aggregate | SearchPage:
    kind = data.get("query")
    if kind == "find":
        return check_find(_load(Find, data, ("query",)))
    if kind in ("count", "exists"):
        q = _load(Count if kind == "count" else Exists, data, ("query",))
        check_filter(q.filter)
        return q
    if kind == "aggregate":
        return check_aggregate(_load(Aggregate, data, ("query",)))
    if kind == "search_page":
        page = SearchPage(check_find(_load(Find, data["find"])), data["page_size"], data.get("cursor"))
        if page.page_size < 1 or not page.find.ranked:
            raise invalid("a page needs a size of 1 at least and a ranked query")
        return page
    raise invalid(f"unknown query '{kind}'")


def read_mutation(data: dict[str, Any]) -> Mutation:
    kind = data.get("mutation")
    if kind not in ("insert", "bulk_insert", "update", "delete", "upsert"):
        raise invalid(f"unknown mutation '{kind}'")
    check_filter(data.get("filter"))
    records = data.get("records") or ([data["fields"]] if "fields" in data else [])
    if len(records) > MOST_WRITES:
        raise EngineError("limit_exceeded", f"more than {MOST_WRITES} records")
    return Mutation(kind, data["collection"], records, data.get("filter"), data.get("set") or {})
