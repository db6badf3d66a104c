"""Filter trees as columns, with two-valued logic.

A comparison on a missing value is false, so its negation is true. Types are told from the schema:
a comparison of types that have no order is false, and ``ne`` of them true where there is a value.
SQL null means missing. Outside of negations a null condition filters just as false does, so leaves
there stay bare and reach the scan; under a negation they are made false first.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as text_functions


class Path:
    """A dotted path: a column, a field of structs, or a path within a JSON or variant column."""

    def __init__(self, df: DataFrame, path: str):
        parts = path.split(".")
        self.kind, self.column, self.variant = "missing", F.lit(None), None
        found = next((f for f in df.schema.fields if f.name == path), None) or next((f for f in df.schema.fields if f.name == parts[0]), None)
        if found is None:
            return
        column, kind, rest = df[f"`{found.name}`"], found.dataType, [] if found.name == path else parts[1:]
        while rest and isinstance(kind, T.StructType):
            inner = next((f for f in kind.fields if f.name == rest[0]), None)
            if inner is None:
                return
            column, kind, rest = column.getField(rest[0]), inner.dataType, rest[1:]
        document = isinstance(kind, T.VariantType) or isinstance(kind, T.StringType) and (found.metadata or {}).get("document") or rest and isinstance(kind, T.StringType)
        if rest or isinstance(kind, T.VariantType):
            if not document:
                return
            whole = column if isinstance(kind, T.VariantType) else F.try_parse_json(column)
            self.kind, self.variant = "variant", whole
            self.pointer = "$" + "".join(f".{p}" for p in rest)
            self.column = F.try_variant_get(whole, self.pointer, "variant")
            return
        self.column = column
        self.kind = (
            "number" if isinstance(kind, T.NumericType) else "text" if isinstance(kind, T.StringType) else "bool" if isinstance(kind, T.BooleanType)
            else "time" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "other"
        )
        self.type = kind

    def typed(self, kind: str) -> Column | None:
        """The value as a number, text, bool or time; None where it can't be."""
        if self.kind == "variant":
            names = {"number": ("BIGINT", "DOUBLE", "FLOAT"), "text": ("STRING",), "bool": ("BOOLEAN",)}.get(kind)
            if names is None:
                return None
            like = "^(" + "|".join(names) + (r"|DECIMAL\(.*" if kind == "number" else "") + ")$"
            # within an array of one the document is parsed once, for its type and its value
            fits = F.filter(F.array(self.column), lambda v: F.schema_of_variant(v).rlike(like))
            return F.try_variant_get(F.get(fits, F.lit(0)), "$", {"number": "double", "text": "string", "bool": "boolean"}[kind])
        if self.kind == kind:
            return self.column
        if (self.kind, kind) == ("time", "number"):
            return F.unix_millis(self.column.cast("timestamp"))
        return None

    def present(self) -> Column:
        if self.kind == "missing":
            return F.lit(False)
        if self.kind == "variant":
            return self.column.isNotNull() & ~F.is_variant_null(self.column)
        return self.column.isNotNull()


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, dict) and set(value) == {"$timestamp"}:
        return "time"
    return "null" if value is None else "other"


def _sides(path: Path, value: Any) -> tuple[Column, Column] | None:
    """Both sides of a comparison, or None where their types can't be compared."""
    kind = kind_of(value)
    if kind == "time" or kind == "number" and path.kind == "time":
        ms = value["$timestamp"] if kind == "time" else value
        if path.kind == "time":
            return path.column, F.expr(f"timestamp_millis({int(ms)})").cast(path.type)  # foldable, so that it reaches the scan
        number = path.typed("number")
        return None if number is None else (number, F.lit(int(ms)))
    column = path.typed(kind) if kind in ("number", "text", "bool") else None
    if column is None or kind == "number" and isinstance(value, float) and math.isnan(value):
        return None
    return column, F.lit(value)


def _compare(path: Path, op: str, value: Any) -> Column:
    if op == "in":
        every = [s for v in (value if isinstance(value, list) else []) if (s := _sides(path, v))]
        if not every:
            return F.lit(False)
        if path.kind != "variant" and len({kind_of(v) for v in value}) == 1:
            return every[0][0].isin(*[r for _, r in every])
        hit = every[0][0] == every[0][1]
        for left, right in every[1:]:
            hit = hit | (left == right)
        return hit
    sides = _sides(path, value)
    if sides is None:
        return path.present() if op == "ne" else F.lit(False)
    left, right = sides
    if op == "ne":
        return F.coalesce(left != right, path.present()) if path.kind == "variant" else left != right
    test = {"eq": lambda: left == right, "lt": lambda: left < right, "lte": lambda: left <= right, "gt": lambda: left > right, "gte": lambda: left >= right}[op]()
    if kind_of(value) == "number" and isinstance(getattr(path, "type", None), (T.DoubleType, T.FloatType)) and op in ("gt", "gte"):
        test = test & ~F.isnan(left)
    return test


def condition(df: DataFrame, node: dict | None, negated: bool = False) -> Column:
    """The filter as a condition over ``df``; always true or false under a negation."""
    if node is None:
        return F.lit(True)
    kind = node["type"]
    if kind in ("and", "or"):
        total = None
        for below in node["filters"]:
            part = condition(df, below, negated)
            total = part if total is None else (total & part if kind == "and" else total | part)
        return F.lit(kind == "and") if total is None else total
    if kind == "not":
        return ~condition(df, node["filter"], True)
    path = Path(df, node["field"])
    if kind == "exists":
        return path.present()
    if kind == "compare":
        leaf = _compare(path, node["op"], node["value"])
    elif (column := path.typed("text")) is None:
        leaf = F.lit(False)
    elif kind == "contains":
        leaf = F.contains(column, F.lit(node["substring"]))
    else:
        leaf = has_tokens(column, node["query"])
    return F.coalesce(leaf, F.lit(False)) if negated else leaf


def has_tokens(column: Column, query: str) -> Column:
    """All tokens of the query are among those of the text; false for a query without any."""
    wanted = text_functions.query_terms(query)
    if not wanted:
        return F.lit(False)
    # a substring test is cheap and lets few texts through to be split
    low, found = F.lower(column), text_functions.tokens(column)
    test = F.lit(True)
    for term in wanted:
        test = test & F.contains(low, F.lit(term))
    return test & (F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), found)) == 0)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
