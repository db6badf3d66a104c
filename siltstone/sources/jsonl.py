"""JSON Lines: dump and restore of collections, verification of a dump, and relevance sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.plans.catalog import Schema, load

JUDGED = "query_id string, doc_id string, relevance int"
CORPUS = "id string, title string, body string, tags array<string>, category string, vector array<float>"
QUERIES = "id string, text string, tags array<string>, vector array<float>"


def targets_first(schemas: list[Schema]) -> list[Schema]:
    """Schemas after those that they link to; cycles come last, in their order."""
    left, done = list(schemas), []
    while left:
        ready = [s for s in left if all(x.target == s.name or x.target in {d.name for d in done} or x.target not in {y.name for y in left} for x in s.links)]
        if not ready:
            return done + left
        done += ready
        left = [s for s in left if s not in ready]
    return done


def dump(spark: SparkSession, collections: list[tuple[Schema, DataFrame]], path: str) -> None:
    """A folder of text: a part of schema lines, then the record lines of each collection, targets first."""
    from dataclasses import asdict

    by = {s.name: d for s, d in collections}
    order = targets_first([s for s, _ in collections])
    head = [json.dumps({"schema": asdict(s)}) for s in order]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-schemas")
    for n, s in enumerate(order, 1):
        df = by[s.name]
        line = F.to_json(F.struct(F.struct(F.lit(s.name).alias("collection"), F.struct(*[F.col(c) for c in df.columns]).alias("fields")).alias("record")))
        df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/{n}-records")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path)


def restore(spark: SparkSession, path: str) -> tuple[list[Schema], dict[str, DataFrame]]:
    """Schemas in order, and the records of each collection with the types that its schema declares.

    A dump of this module has a folder for each collection, and only that is read; of other folders of
    lines all are.
    """
    from siltstone.plans.catalog import TYPES
    from siltstone.sources.files import Files

    parts = {n for n, _, _ in Files(spark).names(path)}
    schemas = [load(json.loads(r[0])["schema"]) for r in spark.read.text(f"{path}/0-schemas").collect()]
    found = {}
    for place, s in enumerate(schemas, 1):
        raw = spark.read.text(f"{path}/{place}-records") if f"{place}-records" in parts else lines(spark, path)
        types = {f.name: TYPES[f.type] for f in s.fields} | {x.name: "string" if x.cardinality == "to_one" else "array<string>" for x in s.links}
        shape = "record struct<collection:string,fields:struct<" + ",".join(f"`{n}`:{t}" for n, t in types.items()) + ">>"
        found[s.name] = raw.select(F.from_json("value", shape).alias("x")).filter(F.col("x.record.collection") == s.name).select("x.record.fields.*")
    return schemas, found


def verify(spark: SparkSession, path: str, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Counts of each collection, malformed lines, keys that occur twice, and records of collections without a schema."""
    raw = lines(spark, path).filter(F.length(F.trim("value")) > 0)
    collection = F.get_json_object("value", "$.record.collection")
    good = F.get_json_object("value", "$.schema.name").isNotNull() | collection.isNotNull()
    records = raw.filter(collection.isNotNull()).withColumn("collection", collection)
    key = F.lit(None).cast("string")
    for name, field in keys.items():
        key = F.when(F.col("collection") == name, F.get_json_object("value", f"$.record.fields.{field}")).otherwise(key)
    return {
        "counts": records.groupBy("collection").agg(F.count(F.lit(1)).alias("records")),
        "malformed": raw.filter(~F.coalesce(good, F.lit(False))),
        "duplicates": records.withColumn("key", key).filter("key is not null").groupBy("collection", "key").count().filter("count > 1"),
        "without_schema": records.join(raw.select(F.get_json_object("value", "$.schema.name").alias("collection")).filter("collection is not null").distinct(), "collection", "left_anti").groupBy("collection").count(),
    }


def relevance(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A corpus, queries or judgments, checked: ids are there and differ, texts aren't empty, vectors have one length."""
    df = spark.read.schema({"corpus": CORPUS, "queries": QUERIES, "qrels": JUDGED}[kind]).json(path)
    if kind == "qrels":
        if df.filter("query_id is null or doc_id is null or relevance is null").limit(1).count():
            raise EngineError("invalid_request", "a judgment lacks an id or grade")
        return df  # a judgment of something unknown is a warning of the evaluation
    text = F.concat_ws("", "title", "body", "tags", "category") if kind == "corpus" else F.col("text")
    checks = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count(F.nullif("id", F.lit(""))).alias("named"),
        F.count("vector").alias("vectors"), F.count_distinct(F.size("vector")).alias("sizes"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("blank"),
    ).first()
    if checks["blank"]:
        raise EngineError("invalid_request", "texts must not be empty")
    if checks["ids"] < checks["n"] or checks["named"] < checks["n"]:
        raise EngineError("invalid_request", "ids must be there, and differ")
    if checks["vectors"] not in (0, checks["n"]) or checks["vectors"] and checks["sizes"] > 1:
        raise EngineError("invalid_request", "all entries need vectors of one length, or none")
    return df


def query_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One array of numbers a line."""
    return spark.read.text(path).select(F.from_json("value", "array<float>").alias("vector"))
