"""Metrics, facets and groups over the matched set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import invalid
from siltstone.operators import search
from siltstone.plans.ir import Aggregate
from siltstone.plans.predicates import Path, condition
from siltstone.sources.text_index import TextIndex

FACET, GROUP = 10, 1000


def matched(df: DataFrame, q: Aggregate, key: str, index: TextIndex | None = None) -> DataFrame:
    rows = df.filter(condition(df, q.filter)) if q.filter else df
    if q.text_search:
        rows = rows.join(search.candidates(df, key, q.text_search, scoped=True, index=index).select(key), key, "left_semi")
    return rows


def scalar(df: DataFrame, name: str) -> Column:
    path = Path(df, name)
    if path.kind in ("missing", "other"):
        raise invalid(f"'{name}' isn't a scalar field")
    return path.column.cast("string") if path.kind == "variant" else path.column


def metric(df: DataFrame, m: dict) -> Column:
    """One of count (of records), min, max and avg; NaN and null count for nothing, and only numbers have a mean."""
    if m["op"] == "count":
        return F.count(F.lit(1)).alias(label(m))
    path = Path(df, m["field"])
    number = path.typed("number") if path.kind != "time" else None
    if m["op"] == "avg":
        value = F.lit(None).cast("double") if number is None else number.cast("double")
        return F.avg(F.when(~F.isnan(value), value)).alias(label(m))
    value = scalar(df, m["field"]) if number is None else number
    if number is not None:
        value = F.when(~F.isnan(value.cast("double")), value)
    return (F.min if m["op"] == "min" else F.max)(value).alias(label(m))


def label(m: dict) -> str:
    return m["op"] if m["op"] == "count" else f"{m['op']}_{m['field'].replace('.', '_')}"


def metrics(rows: DataFrame, wanted: list[dict]) -> DataFrame:
    return rows.agg(*[metric(rows, m) for m in wanted])


def facet(rows: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """(value, count): the commonest values, ties by value."""
    counted = rows.select(scalar(rows, name).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.col("count").desc(), "value").limit(FACET if limit is None else limit)


def groups(rows: DataFrame, name: str, wanted: list[dict], limit: int | None = None) -> DataFrame:
    """(key, count, metrics, group_count_total): the largest groups, ties by key; null keys are left out."""
    keyed = rows.withColumn("key", scalar(rows, name)).filter(F.col("key").isNotNull())
    made = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count"), *[metric(rows, m) for m in wanted if m["op"] != "count"])
    total = made.agg(F.count(F.lit(1)).alias("group_count_total"))
    return made.orderBy(F.col("count").desc(), "key").limit(GROUP if limit is None else limit).crossJoin(F.broadcast(total))  # one row


def aggregate(df: DataFrame, q: Aggregate, key: str, index: TextIndex | None = None) -> dict:
    """The matched set once, and DataFrames of its metrics, facets and groups; ``counts`` has how many were scanned and matched."""
    rows = matched(df, q, key, index)
    out: dict = {
        "counts": df.agg(F.count(F.lit(1)).alias("scanned")).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("matched")))),  # one row each
        "matched": rows, "filter_present": q.filter is not None, "search_scoped": q.text_search is not None, "used_index": False,
    }
    if q.metrics and not q.group_by:
        out["metrics"] = metrics(rows, q.metrics)
    out["facets"] = {f["field"]: facet(rows, f["field"], f.get("limit")) for f in q.facets}
    if q.group_by:
        out["groups"] = groups(rows, q.group_by, q.metrics, q.group_limit)
    return out
