"""Text analysis, snippets, JSON Lines, relevance sets, streams and the store's pointer."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.errors import EngineError
from siltstone.functions import text as T
from siltstone.functions.snippets import fragments
from siltstone.functions.vectors import distance
from siltstone.operators import nearest, relevance
from siltstone.plans.catalog import FieldDef, Link, Schema
from siltstone.sources import jsonl
from siltstone.sources.store import Store
from siltstone.streaming.ingest import follow


def code(run) -> str:
    with pytest.raises(EngineError) as e:
        run()
    return e.value.code


def test_analyzers_by_name_and_offsets_in_bytes():
    assert T.resolve(None) == T.resolve("simple") == "default" and code(lambda: T.resolve("other")) == "invalid_request"
    assert T.offsets("Über Äpfel, 2x", "ascii_fold") == [("uber", 0, 5), ("apfel", 6, 12), ("2x", 14, 16)]
    assert T.offsets("  A Key-Word ", "keyword") == [("a key-word", 2, 12)] and T.offsets("  ", "keyword") == []
    assert T.query_terms("the lenses of foxes, boxes and tokens", "english_basic") == ["lens", "fox", "box", "tokens"]


def test_snippets_hold_what_was_asked_for():
    text = "An apple. " + "filler words " * 20 + "Äpfel and an apple again"
    whole = fragments(text, {"apple"}, "default", 3, 1000)
    assert whole[0]["text"] == text and len(whole[0]["ranges"]) == 2
    parts = fragments(text, {"apple"}, "default", 3, 20)
    assert [p["text"][:5] for p in parts] == ["apple", "apple"]
    for p in parts:
        for r in p["ranges"]:
            assert p["text"].encode()[r["start"] : r["end"]].decode().lower() == "apple"
    assert len(fragments(text, {"apple"}, "default", 1, 20)) == 1 and fragments(text, {"absent"}, "default", 3, 20) == []


def test_distances_go_with_the_metric(spark):
    got = spark.range(1).select(distance(F.lit(0.25), "cosine"), distance(F.lit(-2.0), "euclidean"), distance(F.lit(3.0), "dot")).first()
    assert tuple(got) == (0.75, 2.0, -3.0)


PARENT = Schema("Parent", [FieldDef("id", "int", primary_key=True), FieldDef("name", "string")])
CHILD = Schema("Child", [FieldDef("id", "int", primary_key=True), FieldDef("x", "float")], [Link("parent", "Parent")])


def test_a_dump_is_restored_and_verified(spark, tmp_path):
    path = str(tmp_path / "dump")
    parents = spark.createDataFrame([(1, "a\nb"), (2, None)], "id bigint, name string")
    children = spark.createDataFrame([(5, 1.5, "1"), (6, None, "2")], "id bigint, x double, parent string")
    jsonl.dump(spark, [(CHILD, children), (PARENT, parents)], path)
    schemas, found = jsonl.restore(spark, path)
    assert [s.name for s in schemas] == ["Parent", "Child"] and schemas[1].links[0].target == "Parent"
    assert sorted(map(tuple, found["Parent"].collect())) == [(1, "a\nb"), (2, None)] and sorted(map(tuple, found["Child"].collect()), key=str) == [(5, 1.5, "1"), (6, None, "2")]
    good = jsonl.verify(spark, path, {"Child": "id", "Parent": "id"})
    assert {tuple(r) for r in good["counts"].collect()} == {("Parent", 2), ("Child", 2)} and all(good[x].isEmpty() for x in ("malformed", "duplicates", "without_schema"))
    (tmp_path / "dump" / "more.txt").write_text('not json\n\n{"record": {"collection": "Child", "fields": {"id": 5}}}\n{"record": {"collection": "Other", "fields": {}}}\n')
    bad = jsonl.verify(spark, path, {"Child": "id", "Parent": "id"})
    assert [r[0] for r in bad["malformed"].collect()] == ["not json"] and [tuple(r) for r in bad["duplicates"].collect()] == [("Child", "5", 2)]
    assert [r["collection"] for r in bad["without_schema"].collect()] == ["Other"]


CORPUS = [{"id": "a", "title": "Red", "body": "apples grow", "tags": ["fruit"], "vector": [1, 0]}, {"id": "b", "body": "green pears", "vector": [0, 1]}, {"id": "c", "title": "red pears", "vector": [1, 1]}]
ASKED = [{"id": "q1", "text": "red apples", "vector": [1, 0]}, {"id": "q2", "text": "pears", "vector": [0, 1]}, {"id": "q3", "text": "red"}]
JUDGED = [{"query_id": "q1", "doc_id": "a", "relevance": 2}, {"query_id": "q2", "doc_id": "b", "relevance": 1}, {"query_id": "q2", "doc_id": "zz", "relevance": 0}, {"query_id": "q9", "doc_id": "a", "relevance": 1}]


def lines(tmp_path, name: str, rows: list) -> str:
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_relevance_sets_are_checked_and_evaluated_in_every_mode(spark, tmp_path):
    corpus = jsonl.relevance(spark, lines(tmp_path, "c", CORPUS), "corpus")
    queries = jsonl.relevance(spark, lines(tmp_path, "q", [{**q, "vector": q.get("vector", [1, 1])} for q in ASKED]), "queries")
    qrels = jsonl.relevance(spark, lines(tmp_path, "r", JUDGED), "qrels").withColumnRenamed("relevance", "grade")
    for bad in ([*CORPUS, CORPUS[0]], [{**CORPUS[0], "id": ""}], [{"id": "x", "vector": [1, 0]}], [*CORPUS, {"id": "d", "body": "no vector"}], [*CORPUS, {"id": "d", "body": "long", "vector": [1, 0, 0]}]):
        assert code(lambda: jsonl.relevance(spark, lines(tmp_path, "bad", bad), "corpus")) == "invalid_request"  # noqa: B023
    assert code(lambda: jsonl.relevance(spark, lines(tmp_path, "bad", [{"id": "q", "text": " "}]), "queries")) == "invalid_request"
    assert code(lambda: jsonl.relevance(spark, lines(tmp_path, "bad", [{"query_id": "q"}]), "qrels")) == "invalid_request"
    # vectors of longer ids than numbers need numbers as keys
    ids = {"a": 1, "b": 2, "c": 3}
    number = F.coalesce(*[F.when(F.col("id") == k, v) for k, v in ids.items()], F.lit(99)).cast("bigint")
    docs = corpus.select(number.alias("doc_id"), relevance.searchable("title", "body", "tags", "category").alias("text"), "vector")
    own = F.substring("id", 2, 1).cast("bigint")
    asked = queries.select(own.alias("query_id"), "text", F.when(F.col("id") != "q3", F.col("vector")).alias("vector"))
    judged = qrels.select(F.substring("query_id", 2, 1).cast("bigint").alias("query_id"), F.coalesce(*[F.when(F.col("doc_id") == k, v) for k, v in ids.items()], F.lit(99)).cast("bigint").alias("doc_id"), "grade")
    assert [r[0] for r in docs.orderBy("doc_id").select("text").collect()] == ["Red apples grow fruit", "green pears", "red pears"]
    for mode in ("bm25", "vector_exact", "hybrid"):
        out = relevance.search_eval(docs, asked, judged, 2, mode)
        per = {r["query_id"]: (r["mrr"], r["recall"]) for r in out["per_query"].collect()}
        assert per[1] == (1.0, 1.0) and per[2][1] == 1.0 and out["macro"].first()["queries"] == 3
        assert [w for w in out["warnings"] if "without a relevant" in w] == ["1 queries without a relevant judgment"] and any("unknown documents" in w for w in out["warnings"]) and any("unknown queries" in w for w in out["warnings"])
        assert any("without a vector" in w for w in out["warnings"]) == (mode != "bm25")
    assert code(lambda: relevance.search_eval(docs, asked, judged, 2, "other")) == "invalid_request"


def test_query_vectors_and_the_recall_of_cells(spark, tmp_path, small):
    path = tmp_path / "v.jsonl"
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    path.write_text("\n".join(json.dumps([float(x) for x in r[0]]) for r in df.limit(3).select("embedding").collect()))
    queries = [list(r[0]) for r in jsonl.query_vectors(spark, str(path)).collect()]
    cells = nearest.Cells.opened(df, "vec_id", "embedding", str(tmp_path / "cells"))
    out = relevance.vector_eval(df, "vec_id", "embedding", cells, queries, 10)
    assert out["queries"] == 3 and out["min_recall"] >= 0.8 and out["mean_recall"] >= 0.85 and out["exact_p50_ms"] > 0
    again = nearest.Cells.opened(df, "vec_id", "embedding", str(tmp_path / "cells"))
    assert (again.centres == cells.centres).all() and again.stored.count() == df.count()
    assert again.search("vec_id", "embedding", queries[0], 5).collect() == cells.search("vec_id", "embedding", queries[0], 5).collect()


def test_a_stream_upserts_and_commits_a_batch_once(spark, tmp_path):
    store, inbox = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n')
    run = lambda: follow(store, "T", str(inbox), "id bigint, v string", "id", str(tmp_path / "check"), once=True).awaitTermination()
    run()
    (inbox / "2.json").write_text('{"id": 2, "v": "c"}\n')
    run()
    assert sorted((r["id"], r["v"]) for r in store.read("T").collect()) == [(1, "a"), (2, "c")] and store.state["ts"] == 2
    puts = spark.createDataFrame([("1", 1, "z")], "record_id string, id bigint, v string")
    assert store.commit({"T": (puts, None)}, (str(tmp_path / "check"), 1)) == 2  # a batch that is run again
    assert sorted((r["id"], r["v"]) for r in store.read("T").collect()) == [(1, "a"), (2, "c")]
    assert Store(spark, str(tmp_path / "store")).state == store.state


def test_schemas_are_checked():
    for bad in (
        Schema("", []), Schema("A", [FieldDef("x", "string"), FieldDef("x", "int")]), Schema("A", [FieldDef("x", "string", primary_key=True), FieldDef("y", "int", primary_key=True)]), Schema("A", [FieldDef("x", "thing")]),
        Schema("A", [FieldDef("v", "vector")]), Schema("A", [FieldDef("x", "int")], full_text=["x"]), Schema("A", [FieldDef("x", "int")], document_paths=["x.y"]), Schema("A", [FieldDef("x", "int")], [Link("x", "B")]),
    ):
        assert code(bad.check) == "invalid_request"


def test_an_engine_without_a_path_keeps_nothing(spark):
    assert code(lambda: Engine(spark).create(PARENT)) == "unsupported"
