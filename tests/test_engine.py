"""The engine with a store: writes, transactions, links, versions, cursors, indexes, and what goes wrong."""

from __future__ import annotations

import time

import pytest

from siltstone.engine import Engine
from siltstone.errors import EngineError
from siltstone.plans import cursor, ir
from siltstone.plans.catalog import FieldDef, Link, Schema

USER = Schema("User", [FieldDef("id", "string", primary_key=True), FieldDef("name", "string", indexed=True)])
DOC = Schema(
    "Doc",
    [
        FieldDef("id", "string", primary_key=True), FieldDef("email", "string", unique=True), FieldDef("status", "string", nullable=False, indexed=True), FieldDef("views", "int"),
        FieldDef("body", "string"), FieldDef("meta", "document"), FieldDef("vec", "vector", dim=3),
    ],
    [Link("owner", "User"), Link("editors", "User", "to_many")], full_text=["body"], document_paths=["meta.source"],
)


def doc(k: int, **more) -> dict:
    return {"id": f"d{k}", "email": f"{k}@x.org", "status": "new", "views": k, "body": f"red apple {'pear ' * k}", "meta": {"source": f"s{k % 2}"}, "vec": [1.0, float(k), 0.0], "owner": "u1", **more}


def eq(field: str, value) -> dict:
    return {"type": "compare", "field": field, "op": "eq", "value": value}


def insert(*records: dict, kind: str = "bulk_insert", name: str = "Doc") -> dict:
    return {"mutation": kind, "collection": name, "records": list(records)}


def find(e: Engine, name: str = "Doc", txn=None, as_of=None, **more) -> list:
    return e.find({"query": "find", "collection": name, **more}, as_of, txn).collect()


def code(run) -> str:
    with pytest.raises(EngineError) as e:
        run()
    return e.value.code


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.create(USER)
    e.create(DOC)
    e.apply(insert({"id": "u1", "name": "Ann"}, {"id": "u2", "name": "Bob"}, name="User"))
    e.apply(insert(*[doc(k) for k in range(4)]))
    return e


def test_writes_and_their_results(engine):
    out = engine.apply(insert(doc(9, owner=None, editors=["u2", "u1"])))
    assert out == {"inserted": 1, "updated": 0, "deleted": 0, "ids": ["d9"]}
    assert engine.apply(insert(doc(9, views=90), doc(10), kind="upsert")) == {"inserted": 1, "updated": 1, "deleted": 0, "ids": ["d9", "d10"]}
    assert engine.apply({"mutation": "update", "collection": "Doc", "filter": eq("meta.source", "s1"), "set": {"status": "seen"}})["updated"] == 3
    assert engine.apply({"mutation": "delete", "collection": "Doc", "filter": eq("id", "d10")})["deleted"] == 1
    rows = {r["id"]: r for r in find(engine)}
    assert sorted(rows) == ["d0", "d1", "d2", "d3", "d9"] and rows["d9"]["views"] == 90 and [rows[f"d{k}"]["status"] for k in (0, 1, 3)] == ["new", "seen", "seen"]
    assert engine.count({"query": "count", "collection": "Doc", "filter": eq("status", "seen")}) == 3 and engine.exists({"query": "exists", "collection": "Doc"})
    assert engine.get("Doc", "d1")["status"] == "seen" and engine.get("Doc", "d1", as_of=2)["status"] == "new" and engine.get("Doc", "none") is None


def test_what_a_write_may_not_do(engine):
    assert code(lambda: engine.apply(insert(doc(1)))) == "unique_violation"
    assert code(lambda: engine.apply(insert(doc(20), doc(20)))) == "unique_violation"
    assert code(lambda: engine.apply(insert(doc(20, email="1@x.org")))) == "unique_violation"
    assert code(lambda: engine.apply(insert(doc(20, status=None)))) == "schema_violation"
    assert code(lambda: engine.apply(insert(doc(20, views="many")))) == "schema_violation"
    assert code(lambda: engine.apply(insert(doc(20, vec=[1.0])))) == "schema_violation"
    assert code(lambda: engine.apply(insert(doc(20, owner="nobody")))) == "conflict"
    assert code(lambda: engine.apply({"mutation": "delete", "collection": "User", "filter": eq("id", "u1")})) == "conflict"
    assert code(lambda: engine.apply({"mutation": "update", "collection": "Doc", "filter": eq("id", "d1"), "set": {"id": "x"}})) == "invalid_request"
    assert code(lambda: engine.apply({"mutation": "update", "collection": "Doc", "set": {"email": "same"}})) == "unique_violation"
    assert code(lambda: engine.apply({"mutation": "update", "collection": "Doc", "set": {"status": None}})) == "schema_violation"
    assert code(lambda: engine.apply(insert({"id": "x"}, name="Nothing"))) == "not_found"
    assert len(find(engine)) == 4 and not engine.active


def test_a_transaction_sees_its_own_writes_and_a_snapshot(engine):
    txn = engine.begin()
    engine.stage(txn, insert(doc(30)))
    engine.stage(txn, {"mutation": "delete", "collection": "Doc", "filter": eq("id", "d0")})
    engine.apply(insert(doc(40)))
    seen = {r["id"] for r in find(engine, txn=txn)}
    assert seen == {"d1", "d2", "d3", "d30"} and {r["id"] for r in find(engine)} == {"d0", "d1", "d2", "d3", "d40"}
    assert engine.get("Doc", "d30", txn=txn)["views"] == 30 and engine.get("Doc", "d0", txn=txn) is None and engine.get("Doc", "d30") is None
    assert engine.request({"query": "count", "collection": "Doc"}, txn) == 4
    out = engine.explain({"query": "find", "collection": "Doc", "filter": eq("id", "d30")}, analyze=True, txn=txn)
    assert (out["scanned"], out["matched"], out["returned"], out["snapshot_ts"]) == (4, 1, 1, txn.read_ts)
    assert [t["id"] for t in engine.transactions()] == [txn.id] and engine.stats()["oldest_read_ts"] == txn.read_ts
    engine.commit(txn)
    assert {r["id"] for r in find(engine)} == {"d1", "d2", "d3", "d30", "d40"}
    assert code(lambda: engine.commit(txn)) == "conflict" and not engine.transactions()


def test_the_first_to_commit_wins(engine):
    a, b, c = engine.begin(), engine.begin(), engine.begin()
    for txn, views in ((a, 100), (b, 200)):
        engine.stage(txn, {"mutation": "update", "collection": "Doc", "filter": eq("id", "d1"), "set": {"views": views}})
    engine.stage(c, {"mutation": "update", "collection": "Doc", "filter": eq("id", "d2"), "set": {"views": 300}})
    engine.commit(a)
    assert code(lambda: engine.commit(b)) == "conflict"
    engine.commit(c)
    assert {r["id"]: r["views"] for r in find(engine)} == {"d0": 0, "d1": 100, "d2": 300, "d3": 3}


def test_unique_values_and_links_are_checked_again_at_the_commit(engine):
    a = engine.begin()
    engine.stage(a, insert(doc(50, email="taken@x.org")))
    engine.apply(insert(doc(51, email="taken@x.org")))
    assert code(lambda: engine.commit(a)) == "unique_violation" and not engine.active
    b = engine.begin()
    engine.stage(b, insert(doc(52, owner="u2")))
    engine.apply({"mutation": "delete", "collection": "User", "filter": eq("id", "u2")})
    assert code(lambda: engine.commit(b)) == "conflict"
    engine.apply(insert({"id": "u3", "name": "Cid"}, name="User"))
    c = engine.begin()
    engine.stage(c, {"mutation": "delete", "collection": "User", "filter": eq("id", "u3")})
    engine.apply(insert(doc(53, owner="u3")))
    assert code(lambda: engine.commit(c)) == "conflict"
    assert engine.get("User", "u3") is not None and engine.get("Doc", "d52") is None


def test_rollback_and_idle_transactions(spark, engine, tmp_path):
    txn = engine.begin()
    engine.stage(txn, {"mutation": "update", "collection": "Doc", "set": {"views": 1}})
    assert (tmp_path / "store" / "staged" / txn.id).exists()
    engine.rollback(txn)
    assert not (tmp_path / "store" / "staged" / txn.id).exists() and code(lambda: engine.stage(txn, insert(doc(60)))) == "conflict"
    engine.idle_timeout_s = 0.05
    late = engine.begin()
    time.sleep(0.1)
    assert code(lambda: engine.commit(late)) == "transaction_timeout"
    engine.begin()
    time.sleep(0.1)
    assert engine.reap() == 1 and not engine.active


def test_a_store_is_opened_again_and_checked(spark, engine, tmp_path):
    path = str(tmp_path / "store")
    again = Engine(spark, path)
    assert again.collections() == ["Doc", "User"] and {r["id"] for r in find(again)} == {"d0", "d1", "d2", "d3"} and again.schema("Doc").links[1].cardinality == "to_many"
    assert again.check() == []
    (tmp_path / "store" / "Doc" / "left-over").mkdir()
    assert again.check() == ["Doc/left-over isn't named by the pointer"]
    assert code(lambda: again.create(DOC)) == "conflict" and code(lambda: again.drop("User")) == "conflict"
    again.drop("Doc")
    assert again.collections() == ["User"] and code(lambda: again.drop("Doc")) == "not_found"
    assert again.check()[0] == "'Doc' has a log and no schema"


def test_versions_are_collected_and_compacted(engine):
    for k in range(3):
        engine.apply({"mutation": "update", "collection": "Doc", "filter": eq("id", "d1"), "set": {"views": 10 + k}})
    pin = engine.begin()
    engine.apply({"mutation": "update", "collection": "Doc", "filter": eq("id", "d1"), "set": {"views": 99}})
    assert engine.gc("Doc", dry_run=True) == (8, 5) and engine.gc("Doc") == (8, 5)
    assert engine.get("Doc", "d1", txn=pin)["views"] == 12
    engine.rollback(pin)
    assert engine.compact("Doc") == 5 and len(engine.store.state["logs"]["Doc"]) == 1 and engine.check() == []
    assert engine.gc("Doc") == (5, 4) and engine.get("Doc", "d1")["views"] == 99
    assert engine.stats()["collections"]["Doc"] == {"records": 4, "versions": 4}


def test_snapshots_are_made_inspected_and_restored(spark, engine, tmp_path):
    folder = str(tmp_path / "copy")
    engine.store.snapshot_to(folder)
    assert engine.store.inspect(folder) == {"ts": 2, "collections": {"User": 2, "Doc": 4}}
    other = Engine(spark, str(tmp_path / "other"))
    other.create(USER)
    other.create(DOC)
    other.store.restore_from(folder)
    assert {r["id"]: r["views"] for r in find(other)} == {f"d{k}": k for k in range(4)}
    assert code(lambda: other.store.inspect(str(tmp_path / "none"))) == "not_found"


def test_links_are_included(engine):
    engine.apply(insert(doc(5, editors=["u2", "u1", "u2"])))
    rows = find(engine, filter=eq("id", "d5"), includes=["owner", "editors"])
    assert [r["name"] for r in rows[0]["includes_owner"]] == ["Ann"] and [r["name"] for r in rows[0]["includes_editors"]] == ["Bob", "Ann", "Bob"]
    assert code(lambda: find(engine, includes=["nobody"])) == "invalid_request"


# --------------------------------------------------------------------------- text indexes

TEXTS = [{"query": "pear apple"}, {"query": "pear red", "operator": "and"}, {"query": "pears", "analyzer": "english_basic"}, {"query": "Pear!", "rank": "term_frequency"}, {"query": "red apple", "analyzer": "keyword"}, {"query": "absent"}]


def ranked(e: Engine, clause: dict, **more) -> list:
    return [(r["id"], round(r["score"], 9), r["rank"]) for r in find(e, text_search={"field": "body", **clause}, limit=10, **more)]


def test_a_stored_index_gives_what_the_texts_give_and_is_maintained(spark, engine, tmp_path):
    plain = [ranked(engine, c) for c in TEXTS]
    assert engine.index("Doc") == {"body": "built"} and engine.index("Doc") == {"body": "current"}
    assert [ranked(engine, c) for c in TEXTS] == plain and any(plain)
    assert engine.explain({"query": "find", "collection": "Doc", "text_search": {"field": "body", "query": "pear"}})["used_index"]
    engine.apply({"mutation": "delete", "collection": "Doc", "filter": eq("id", "d3")})
    engine.apply({"mutation": "update", "collection": "Doc", "filter": eq("id", "d0"), "set": {"body": "green pear tree"}})
    engine.apply(insert(doc(7, body=None), doc(8)))
    assert not engine.indexes_of("Doc")  # it is of an older time, and isn't read
    plain = [ranked(engine, c) for c in TEXTS]
    assert engine.index("Doc") == {"body": "maintained"} and [ranked(engine, c) for c in TEXTS] == plain
    assert all(df.isEmpty() for df in engine.index_check("Doc").values())
    again = Engine(spark, str(tmp_path / "store"))
    assert again.index("Doc") == {"body": "loaded"} and [ranked(again, c) for c in TEXTS] == plain
    assert again.index("Doc", rebuild=True) == {"body": "built"} and [ranked(again, c) for c in TEXTS] == plain
    txn = again.begin()
    again.stage(txn, insert(doc(70)))
    assert again.indexes_of("Doc", txn=txn) == {} and {r["id"] for r in find(again, txn=txn, text_search={"field": "body", "query": "apple"})} >= {"d70"}
    text = {"type": "and", "filters": [{"type": "contains_text", "field": "body", "query": "pear"}, eq("status", "new")]}
    with_index = [(r["id"], r["score"]) for r in find(again, filter=text)]
    again.texts.clear()
    assert with_index == [(r["id"], r["score"]) for r in find(again, filter=text)] and with_index


def test_an_index_of_files_is_loaded_by_content(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "one two"), (2, "two"), (3, None), (4, "!")], "id int, body string").write.parquet(path)
    for want in ("built", "loaded"):
        e = Engine(spark)
        e.register("docs", spark.read.parquet(path), "id")
        assert e.index("docs", "body") == {"body": want}
        index = e.texts["docs", "body"][1]
        assert (index.documents, index.terms, index.words) == (2, 2, 3)
    spark.createDataFrame([(9, "two three")], "id int, body string").write.mode("append").parquet(path)
    e = Engine(spark)
    e.register("docs", spark.read.parquet(path), "id")
    assert e.index("docs", "body") == {"body": "built"} and e.texts["docs", "body"][1].documents == 3


def test_searches_need_the_index_that_the_schema_declares(engine):
    assert code(lambda: find(engine, text_search={"field": "status", "query": "x"})) == "invalid_request"


# --------------------------------------------------------------------------- pages and cursors


def test_ranked_pages_go_on_behind_ties(engine):
    engine.apply(insert(*[doc(k, body="apple same") for k in range(100, 110)]))
    q = {"collection": "Doc", "text_search": {"field": "body", "query": "apple"}}
    whole = [(r["id"], r["rank"]) for r in find(engine, text_search=q["text_search"])]
    got, token = [], None
    while True:
        rows, token = engine.search_page({"query": "search_page", "find": q, "page_size": 4, "cursor": token})
        got += [(r["id"], r["rank"]) for r in rows]
        if token is None:
            break
    assert got == whole and [r for _, r in got] == list(range(1, 15))


def test_tokens_of_other_queries_or_bent_ones_are_refused():
    q = ir.Find("Doc", text_search={"field": "body", "query": "apple"})
    token = cursor.encode(q, 3, 1.5, "d1")
    assert cursor.decode(q, token) == (3, 1.5, "d1")
    other = ir.Find("Doc", text_search={"field": "body", "query": "pear"})
    for query, bad in ((other, token), (q, "zz"), (q, token[:10]), (q, "02" + token[2:]), (q, "")):
        assert code(lambda: cursor.decode(query, bad)) == "invalid_request"  # noqa: B023


def test_a_server_cursor_pages_over_what_was_there_when_it_was_opened(engine):
    name = engine.open_cursor({"query": "find", "collection": "Doc", "order_by": [{"field": "views", "desc": True}], "projection": ["views"]})
    first, more = engine.fetch(name, 3)
    engine.apply(insert(doc(500)))
    rest, last = engine.fetch(name, 3)
    assert [r["views"] for r in first + rest] == [3, 2, 1, 0] and more and not last
    assert code(lambda: engine.fetch(name, 1)) == "not_found"
    ranked_ = engine.open_cursor({"query": "find", "collection": "Doc", "text_search": {"field": "body", "query": "apple"}})
    assert [r["rank"] for r in engine.fetch(ranked_, 2)[0]] == [1, 2] and engine.close_cursor(ranked_) and not engine.close_cursor(ranked_)
    engine.cursors.idle_timeout_s = 0.0
    engine.open_cursor({"query": "find", "collection": "Doc"})
    time.sleep(0.02)
    assert engine.cursors.reap() == 1


# --------------------------------------------------------------------------- limits, errors, plans


def test_a_query_out_of_time_gives_nothing(engine):
    assert code(lambda: engine.rows({"query": "find", "collection": "Doc", "timeout_ms": 1})) == "query_timeout"
    assert len(engine.rows({"query": "find", "collection": "Doc"})) == 4
    engine.query_timeout_ms = 1
    assert code(lambda: engine.rows({"query": "find", "collection": "Doc", "timeout_ms": 60_000})) == "query_timeout"


VECTOR = {"field": "vec", "query": [1.0, 0.0, 0.0], "k": 2}
HYBRID = {"text_field": "body", "text_query": "pear", "vector_field": "vec", "vector": [1.0, 0.0, 0.0], "top_k": 2}


@pytest.mark.parametrize(
    ("request_", "want"),
    [
        ({"query": "find", "vector": VECTOR, "text_search": {"field": "body", "query": "x"}}, "invalid_request"),
        ({"query": "find", "text_search": {"field": "body", "query": " ! "}}, "invalid_request"),
        ({"query": "find", "text_search": {"field": "body", "query": "x", "analyzer": "other"}}, "invalid_request"),
        ({"query": "find", "text_search": {"field": "body", "query": "x", "operator": "xor"}}, "invalid_request"),
        ({"query": "find", "text_search": {"field": "body", "query": "a " * 65}}, "limit_exceeded"),
        ({"query": "find", "vector": VECTOR | {"query": [float("nan")]}}, "invalid_request"),
        ({"query": "find", "vector": VECTOR | {"metric": "hamming"}}, "invalid_request"),
        ({"query": "find", "vector_ann": {}}, "invalid_request"),
        ({"query": "find", "vector": VECTOR, "vector_ann": {"m": 0}}, "invalid_request"),
        ({"query": "find", "vector": VECTOR, "vector_ann": {"ef_construction": 5000}}, "invalid_request"),
        ({"query": "find", "vector": VECTOR, "vector_ann": {"fallback": "maybe"}}, "invalid_request"),
        ({"query": "find", "hybrid": HYBRID | {"top_k": 0}}, "invalid_request"),
        ({"query": "find", "hybrid": HYBRID | {"fusion": "other"}}, "invalid_request"),
        ({"query": "find", "hybrid": HYBRID | {"weights": {"text": 0, "vector": 0}}}, "invalid_request"),
        ({"query": "find", "hybrid": HYBRID | {"weights": {"text": -1, "vector": 2}}}, "invalid_request"),
        ({"query": "find", "limit": -1}, "invalid_request"),
        ({"query": "find", "limit": 2_000_000}, "limit_exceeded"),
        ({"query": "find", "something": 1}, "invalid_request"),
        ({"query": "find", "filter": {"type": "compare", "field": "a", "op": "like", "value": 1}}, "invalid_request"),
        ({"query": "find", "filter": {"type": "exists"}}, "invalid_request"),
        ({"query": "aggregate"}, "invalid_request"),
        ({"query": "aggregate", "metrics": [{"op": "sum", "field": "views"}]}, "invalid_request"),
        ({"query": "aggregate", "metrics": [{"op": "avg"}]}, "invalid_request"),
        ({"query": "aggregate", "group_limit": 3, "metrics": [{"op": "count"}]}, "invalid_request"),
        ({"query": "other"}, "invalid_request"),
    ],
)
def test_requests_are_validated(request_, want):
    assert code(lambda: ir.read_request({"collection": "Doc", **request_})) == want


def test_filters_may_not_nest_too_deep():
    node = eq("a", 1)
    for _ in range(70):
        node = {"type": "not", "filter": node}
    assert code(lambda: ir.read_request({"query": "find", "collection": "Doc", "filter": node})) == "limit_exceeded"


def test_vectors_are_searched_exactly_or_not(engine):
    assert [r["id"] for r in find(engine, vector=VECTOR)] == ["d0", "d1"]
    assert code(lambda: find(engine, vector=VECTOR | {"query": [1.0]})) == "invalid_request"
    assert [r["id"] for r in find(engine, vector=VECTOR, vector_ann={})] == ["d0", "d1"]
    assert code(lambda: find(engine, vector=VECTOR, vector_ann={"fallback": "error"})) == "unsupported"
    engine.apply(insert(*[doc(k) for k in range(200, 240)]))
    asked = VECTOR | {"query": [1.0, 220.0, 0.0], "k": 5}
    exact = [r["id"] for r in find(engine, vector=asked)]
    assert [r["id"] for r in find(engine, vector=asked, vector_ann={})] == exact
    out = find(engine, hybrid=HYBRID, filter=eq("status", "new"))
    assert len(out) == 2 and [r["rank"] for r in out] == [1, 2] and out[0]["score"] >= out[1]["score"]


def test_plans_name_their_nodes_and_clauses(engine):
    def nodes(tree: dict) -> list[str]:
        return [tree["node"], *(nodes(tree["input"]) if "input" in tree else [])]

    base = {"query": "find", "collection": "Doc"}
    for more, node, strategy in (
        ({"filter": eq("id", "d1")}, "PointLookup", "index_lookup"), ({"filter": eq("status", "new")}, "IndexLookup", "index_lookup"), ({"filter": eq("meta.source", "s1")}, "DocumentPathIndexLookup", "index_lookup"),
        ({"filter": {"type": "contains_text", "field": "body", "query": "pear"}}, "FullTextIndexLookup", "full_text_scan"), ({"text_search": {"field": "body", "query": "pear"}}, "FullTextBm25Search", "full_text_bm25"),
        ({"vector": VECTOR}, "VectorSearch", "vector_exact_scan"), ({"hybrid": HYBRID}, "HybridSearch", "hybrid"), ({"filter": eq("views", 1)}, "Scan", "full_scan"),
    ):
        out = engine.explain(base | more)
        assert nodes(out["plan"])[-1] == node and out["strategy"] == strategy and out["clauses"]
    full = engine.explain(base | {"filter": eq("views", 1), "order_by": [{"field": "views", "desc": True}], "offset": 1, "limit": 2, "projection": ["views"], "includes": ["owner"]})
    assert nodes(full["plan"]) == ["RelationshipInclude", "Projection", "Limit", "Offset", "Sort", "Filter", "Scan"] and full["clauses"] == {"filter": "views eq", "order_by": "views desc"}
    assert nodes(engine.explain({"query": "count", "collection": "Doc"})["plan"])[0] == "Count" and nodes(engine.explain({"query": "exists", "collection": "Doc"})["plan"])[0] == "Exists"
    page = {"query": "search_page", "page_size": 2, "find": {"collection": "Doc", "text_search": {"field": "body", "query": "pear"}}}
    assert nodes(engine.explain(page)["plan"])[0] == "Cursor" and nodes(engine.explain({"mutation": "delete", "collection": "Doc"})["plan"])[0] == "Mutation"
    out = engine.explain(base | {"filter": eq("views", 1), "timeout_ms": 500}, analyze=True)
    assert (out["scanned"], out["matched"], out["returned"], out["deadline_ms"], out["snapshot_ts"], out["stats_stale"]) == (4, 1, 1, 500, 2, False) and out["reason"] and out["micros"] > 0
    assert engine.explain(base | {"filter": eq("views", 1)})["plan_id"] == engine.explain(base | {"filter": eq("views", 2)})["plan_id"] != engine.explain(base | {"filter": eq("id", "d1")})["plan_id"]


def test_a_large_scan_is_warned_of(spark):
    e = Engine(spark)
    e.register("n", spark.range(10_001), "id")
    assert e.explain({"query": "find", "collection": "n"})["warnings"]


def test_aggregates_report_what_they_saw(engine):
    out = engine.aggregate({"query": "aggregate", "collection": "Doc", "filter": eq("meta.source", "s1"), "facets": [{"field": "status"}], "metrics": [{"op": "count"}]})
    assert tuple(out["counts"].first()) == (4, 2) and out["metrics"].first()[0] == 2 and out["filter_present"] and not out["search_scoped"] and not out["used_index"]
    report = engine.index_report("Doc")
    assert report["text"]["body"]["documents"] == 4 and report["vectors"]["vec"] == {"dim": 3, "count": 4, "ann": False}
    assert engine.statistics("Doc").first()["distinct_status"] == 1
    assert engine.migration_estimate(Schema("Doc", [FieldDef("id", "string", primary_key=True), FieldDef("views", "int", nullable=False), FieldDef("extra", "string", nullable=False)]))["added"] == ["extra"]


def test_scores_order_a_seeded_filter_unless_an_order_is_given(engine):
    text = {"type": "contains_text", "field": "body", "query": "pear"}
    assert [r["id"] for r in find(engine, filter=text)] == ["d3", "d2", "d1"]
    assert [r["id"] for r in find(engine, filter=text, order_by=[{"field": "views"}])] == ["d1", "d2", "d3"]


def test_requests_are_counted_and_timed(engine):
    engine.request({"query": "count", "collection": "Doc"})
    assert code(lambda: engine.apply(insert(doc(1)))) == "unique_violation"
    seen = engine.metrics.as_dict()
    assert seen["counters"]["records_inserted"] == 6 and seen["counters"]["bulk_insert_errors"] == 1 and seen["requests"]["count"]["count"] == 1 and seen["requests"]["bulk_insert"]["count"] == 3
    text = engine.metrics.prometheus()
    assert "siltstone_records_inserted_total 6\n" in text and 'siltstone_request_seconds_bucket{kind="count",le="+Inf"} 1\n' in text


def test_plans_from_the_command_line(spark, tmp_path, capsys):
    import json

    from siltstone.plans import explain

    spark.range(5).write.parquet(str(tmp_path / "n"))
    (tmp_path / "q.json").write_text(json.dumps({"query": "find", "collection": "n", "filter": eq("id", 3)}))
    assert explain.main([str(tmp_path / "q.json"), str(tmp_path / "n"), "id", "--analyze"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["plan"]["input"]["node"] == "PointLookup" and (out["scanned"], out["matched"], out["returned"]) == (5, 1, 1)
