"""The engine: collections by name, requests as dicts, results as DataFrames."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import EngineError, invalid
from siltstone.metrics import Metrics
from siltstone.operators import aggregate, find, hybrid, nearest, profile, search, versions
from siltstone.plans import cursor, explain, ir
from siltstone.plans.catalog import Catalog, FieldDef, Link, Schema
from siltstone.plans.predicates import condition
from siltstone.sources import text_index
from siltstone.sources.files import Files, cut
from siltstone.sources.store import Store
from siltstone.sources.text_index import TextIndex, Texts


@dataclass
class Transaction:
    """``began`` is when it was last used: one that idles for too long ends."""

    read_ts: int
    began: float
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    puts: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)
    open: bool = True


class Engine:
    """Collections that were registered (any DataFrame) or are kept in a store (with versions and transactions)."""

    def __init__(self, spark: SparkSession, path: str | None = None, query_timeout_ms: int = 30_000, idle_timeout_s: float = 300):
        self.spark = spark
        self.files = Files(spark)
        self.catalog = Catalog(f"{path}/catalog.json" if path else None, self.files)
        self.store = Store(spark, path) if path else None
        self.frames: dict[str, tuple[DataFrame, str]] = {}
        self.query_timeout_ms, self.idle_timeout_s = query_timeout_ms, idle_timeout_s
        self.active: list[Transaction] = []
        self.cells: dict[tuple[str, str], nearest.Cells] = {}
        self.texts: dict[tuple[str, str], tuple[int | None, TextIndex | Texts]] = {}
        self.cursors, self.metrics = Cursors(idle_timeout_s), Metrics()

    # ------------------------------------------------------------------ collections

    def register(self, name: str, df: DataFrame, key: str, schema: Schema | None = None) -> None:
        """A read-only collection over a DataFrame."""
        self.frames[name] = (df, key)
        if schema is not None:
            self.catalog.schemas[name] = schema.check()

    def schema(self, name: str) -> Schema:
        if name in self.catalog.schemas or name not in self.frames:
            return self.catalog.get(name)
        df, key = self.frames[name]
        return Schema(name, [FieldDef(c, "string", primary_key=c == key) for c in df.columns])

    def create(self, schema: Schema) -> None:
        if self.store is None:
            raise EngineError("unsupported", "an engine without a path keeps nothing")
        self.catalog.create(schema)

    def drop(self, name: str) -> None:
        self.catalog.drop(name)

    def collections(self) -> list[str]:
        return sorted({*self.catalog.schemas, *self.frames})

    # ------------------------------------------------------------------ stored indexes

    def index(self, name: str, *fields: str, rebuild: bool = False) -> dict[str, str]:
        """Opens, brings up to date or builds the full-text indexes of a collection: loaded, current, maintained or built, by field.

        Indexes of registered frames are kept in the shared folder by their content; those of a store with
        it, by the timestamp that they are of. From an older one only the records written since are read.
        """
        df, key = self.frame(name)
        report = {}
        for f in fields or self.schema(name).full_text:
            ts = None if name in self.frames else self.store.state["ts"]
            held = self.texts.get((name, f))
            if held and held[0] == ts and not rebuild:
                report[f] = "current"
                continue
            if ts is None:
                if rebuild:
                    text_index.open_index(df, key, f).drop()
                made = text_index.open_index(df, key, f)
                report[f] = "loaded" if made.loaded else "built"
            else:
                made, report[f] = self._stored_index(name, f, df, key, ts, rebuild)
            self.texts[name, f] = (ts, made)
        return report

    def _stored_index(self, name: str, field_name: str, df: DataFrame, key: str, ts: int, rebuild: bool) -> tuple[TextIndex, str]:
        folder = f"{self.store.path}/indexes/{name}-{field_name}"
        there = sorted((int(n) for n, _, _ in self.files.names(folder) if n.isdigit() and int(n) <= ts), reverse=True)
        last = None if rebuild else next((x for x in ((t, text_index.load(self.spark, f"{folder}/{t}")) for t in there) if x[1] is not None), None)
        if last and last[0] == ts:
            return last[1], "loaded"
        log = self.store.log(name)
        if last and log is not None and last[1].key == key:
            changed = cut(log.filter(F.col("commit_ts") > last[0]).select("record_id").distinct())
            gone = self.store.read(name, last[0]).join(changed, "record_id", "left_semi").select(key)
            new = df.join(changed, "record_id", "left_semi").select(key, field_name)
            made, how = text_index.maintained(last[1], gone, new, field_name, f"{folder}/{ts}"), "maintained"
        else:
            made, how = text_index.build(df, key, field_name, f"{folder}/{ts}"), "built"
        for t in there:
            if t != ts:
                self.files.remove(f"{folder}/{t}")
        return made, how

    def indexes_of(self, name: str, as_of: int | None = None, txn: Transaction | None = None) -> dict[str, TextIndex]:
        """The indexes that hold just what such a read sees, by field."""
        if txn is not None and (name in txn.puts or name in txn.deletes):
            return {}
        ts = None if name in self.frames or self.store is None else as_of if as_of is not None else txn.read_ts if txn else self.store.state["ts"]
        return {f: index for (n, f), (t, index) in self.texts.items() if n == name and t == ts}

    def index_check(self, name: str) -> dict[str, DataFrame]:
        """For each open index the postings that it has and shouldn't, or lacks."""
        df, key = self.frame(name)
        return {
            f: profile.inconsistent(index.postings.select("term", key, "tf"), search.postings(df, key, f).select("term", key, "tf"), key) for f, index in self.indexes_of(name).items() if isinstance(index, TextIndex)
        }

    def frame(self, name: str, as_of: int | None = None, txn: Transaction | None = None) -> tuple[DataFrame, str]:
        """The records of a collection, and the name of their key."""
        if name in self.frames:
            return self.frames[name]
        schema = self.catalog.get(name)
        key = schema.key or "record_id"
        df = self.store.read(name, txn.read_ts if txn else as_of) if self.store else None
        if df is None:
            from siltstone.plans.catalog import TYPES

            types = [f"`{f.name}` {TYPES[f.type]}" for f in schema.fields] + [f"`{x.name}` {'string' if x.cardinality == 'to_one' else 'array<string>'}" for x in schema.links]
            df = self.spark.createDataFrame([], ", ".join(["record_id string", *types]))
        else:
            df = df.drop("commit_ts")
        if txn and (name in txn.puts or name in txn.deletes):
            none = df.limit(0)
            df = versions.overlay(df, txn.puts.get(name, none), txn.deletes.get(name, none))
        return df, key

    # ------------------------------------------------------------------ reads

    def request(self, data: dict, txn: Transaction | None = None):
        """Whatever the request asks for: a DataFrame, a number, a truth value, or a dict of DataFrames."""
        q = ir.read_request(data)
        run = {ir.Find: self.find, ir.Count: self.count, ir.Exists: self.exists, ir.Aggregate: self.aggregate, ir.SearchPage: self.search_page}[type(q)]
        with self.metrics.timed(type(q).__name__.lower()):
            return run(q, txn=txn)

    def get(self, name: str, record_id, as_of: int | None = None, txn: Transaction | None = None) -> Row | None:
        """One record by its id: the latest, as of a time, or as a transaction sees it."""
        df, key = self.frame(name, as_of, txn)
        column = "record_id" if "record_id" in df.columns else key
        return df.filter(F.col(column) == F.lit(record_id).cast(dict(df.dtypes)[column])).limit(1).first()

    def find(self, q: ir.Find | dict, as_of: int | None = None, txn: Transaction | None = None) -> DataFrame:
        q = ir.read_request(q) if isinstance(q, dict) else q
        df, key = self.frame(q.collection, as_of, txn)
        schema = self.schema(q.collection)
        cells = None
        for clause in (q.text_search, q.hybrid and {"field": q.hybrid["text_field"]}):
            if clause and q.collection in self.catalog.schemas and clause["field"] not in schema.full_text:
                raise invalid(f"'{clause['field']}' has no full-text index")
        if q.vector:
            declared = schema.field(q.vector["field"])
            nearest.check_dimension(q.vector["query"], declared.dim if declared else None)
            if q.vector_ann is not None and nearest.mode(q.vector_ann, df.filter(F.col(q.vector["field"]).isNotNull()).count()) == "ann_preview":
                place = (q.collection, q.vector["field"])
                latest = as_of is None and txn is None
                if place not in self.cells or not latest:
                    made = nearest.Cells.opened(df, key, q.vector["field"])
                    if latest:
                        self.cells[place] = made
                cells = self.cells[place] if latest else made
        targets = {}
        for name in q.includes:
            link = next((x for x in schema.links if x.name == name), None)
            if link is not None:
                targets[name] = (link, *self.frame(link.target, as_of, txn))
        return find.find(df, q, key, schema, targets, cells, self.indexes_of(q.collection, as_of, txn))

    def rows(self, q: ir.Find | dict, as_of: int | None = None) -> list[Row]:
        """Collected results, within the query's time; a shorter time of its own can only lower the bound."""
        q = ir.read_request(q) if isinstance(q, dict) else q
        ms = min(self.query_timeout_ms, q.timeout_ms or self.query_timeout_ms)
        tag = f"query-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(ms / 1000, stop)
        self.spark.addTag(tag)
        timer.start()
        try:
            found = self.find(q, as_of)
            # a timer that went off between jobs interrupted none
            out = [] if late.is_set() else found.collect()
        except Exception as e:
            if late.is_set():
                raise EngineError("query_timeout", f"more than {ms} ms") from e
            raise
        else:
            if late.is_set():
                raise EngineError("query_timeout", f"more than {ms} ms")
            return out
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def count(self, q: ir.Count | dict, as_of: int | None = None, txn: Transaction | None = None) -> int:
        q = ir.read_request(q) if isinstance(q, dict) else q
        df, _ = self.frame(q.collection, as_of, txn)
        return df.filter(condition(df, q.filter)).count()

    def exists(self, q: ir.Exists | dict, as_of: int | None = None, txn: Transaction | None = None) -> bool:
        q = ir.read_request(q) if isinstance(q, dict) else q
        df, _ = self.frame(q.collection, as_of, txn)
        return not df.filter(condition(df, q.filter)).limit(1).isEmpty()

    def aggregate(self, q: ir.Aggregate | dict, as_of: int | None = None, txn: Transaction | None = None) -> dict:
        q = ir.read_request(q) if isinstance(q, dict) else q
        df, key = self.frame(q.collection, as_of, txn)
        index = self.indexes_of(q.collection, as_of, txn).get(q.text_search["field"]) if q.text_search else None
        return aggregate.aggregate(df, q, key, index)

    def search_page(self, q: ir.SearchPage | dict, txn: Transaction | None = None) -> tuple[list[Row], str | None]:
        """(rows, cursor of the next page or None). Each page ranks anew and resumes behind the last score and key."""
        q = ir.read_request(q) if isinstance(q, dict) else q
        df, key = self.frame(q.find.collection, None, txn)
        whole = replace(q.find, limit=None, offset=None)
        scored, rank = find.scores(df, whole, key, None, self.indexes_of(whole.collection, None, txn)), 0
        rows = scored.join(find.filtered(df, whole, key).select(key), key, "left_semi") if whole.filter else scored
        if q.cursor:
            rank, score, last = cursor.decode(q.find, q.cursor)
            rows = cursor.after(rows, key, score, last)
        best = find.page(rows, replace(whole, limit=q.page_size + 1), key, rank)
        out = find.project(df.join(F.broadcast(best), key), whole, key).orderBy("rank").collect()  # a page of records
        more = len(out) > q.page_size
        out = out[: q.page_size]
        return out, cursor.encode(q.find, rank + len(out), round(out[-1]["score"], 9), str(out[-1][key])) if more else None

    def open_cursor(self, q: ir.Find | dict, txn: Transaction | None = None) -> str:
        """Holds the ordered result of a find, by key, and returns the id under which ``fetch`` pages through it."""
        q = ir.read_request(q) if isinstance(q, dict) else q
        _, key = self.frame(q.collection, None, txn)
        ordered = self.find(replace(q, projection=[], includes=[], snippet=None), txn=txn)
        if not q.ranked:
            ordered = ordered.select(key, F.monotonically_increasing_id().alias("place"))
        held = cut(ordered if q.ranked else hybrid.numbered(ordered, "place", "rank"))
        return self.cursors.open(held, q, key, txn, self.store.state["ts"] if self.store else None)

    def fetch(self, cursor_id: str, n: int) -> tuple[list[Row], bool]:
        """(the next ``n`` rows, whether there are more); an exhausted cursor is closed."""
        held = self.cursors.at(cursor_id)
        keys = held.rows.filter((F.col("rank") > held.done) & (F.col("rank") <= held.done + n))
        df, key = self.frame(held.q.collection, None if held.txn else held.ts, held.txn)
        out = df.join(F.broadcast(keys), key)  # a page
        for name in held.q.includes:
            link = next(x for x in self.schema(held.q.collection).links if x.name == name)
            out = find.include(out, link, *self.frame(link.target, None if held.txn else held.ts, held.txn), key)
        rows = find.project(find.snippets(out, held.q), held.q, key).orderBy("rank").collect() if n > 0 else []
        more = self.cursors.advance(cursor_id, n)
        return rows, more

    def close_cursor(self, cursor_id: str) -> bool:
        return self.cursors.close(cursor_id)

    def explain(self, q: ir.Find | ir.Count | ir.Exists | ir.SearchPage | ir.Mutation | dict, analyze: bool = False, txn: Transaction | None = None) -> dict:
        """What a request would do; with ``analyze``, a find is run and counted. A transaction sees its own records."""
        q = (ir.read_mutation(q) if "mutation" in q else ir.read_request(q)) if isinstance(q, dict) else q
        inner = q.find if isinstance(q, ir.SearchPage) else q if isinstance(q, ir.Find) else ir.Find(q.collection, filter=q.filter)
        df, key = self.frame(inner.collection, None, txn)
        schema, indexes = self.schema(inner.collection), self.indexes_of(inner.collection, None, txn)
        rows = df.count()
        out = explain.explain(df, inner, key, schema, rows, indexes=indexes, over=type(q).__name__)
        if not analyze:
            return out
        ms = min(self.query_timeout_ms, inner.timeout_ms or self.query_timeout_ms)
        ts = txn.read_ts if txn else self.store.state["ts"] if self.store else None
        return out | explain.analyze(df, inner, key, schema, indexes) | {
            "snapshot_ts": ts, "stats_version": ts, "stats_stale": any(t != ts for (n, _), (t, _) in self.texts.items() if n == inner.collection), "deadline_ms": ms,
        }

    def index_report(self, name: str) -> dict:
        df, key = self.frame(name)
        schema = self.schema(name)
        return {
            "text": {f: search.statistics(df, key, f).first().asDict() for f in schema.full_text},
            "vectors": {f.name: {"dim": f.dim, "count": (n := df.filter(F.col(f.name).isNotNull()).count()), "ann": n >= nearest.ANN_LEAST} for f in schema.fields if f.type == "vector"},
        }

    def statistics(self, name: str) -> DataFrame:
        df, _ = self.frame(name)
        schema = self.schema(name)
        return profile.statistics(df, [f.name for f in schema.fields if f.indexed or f.primary_key], schema.full_text, [f.name for f in schema.fields if f.type == "vector"])

    def migration_estimate(self, target: Schema) -> dict:
        df, _ = self.frame(target.name)
        return profile.migration(df, self.schema(target.name), target)

    def stats(self) -> dict:
        """Collections with their records and versions, open transactions and the oldest timestamp that one reads."""
        own = {n: {"records": self.frame(n)[0].count(), "versions": log.count() if self.store and n in self.store.state["logs"] and (log := self.store.log(n)) is not None else None} for n in self.collections()}
        return {"collections": own, "commit_ts": self.store.state["ts"] if self.store else None, "transactions": len(self.active), "oldest_read_ts": min([t.read_ts for t in self.active], default=None), "cursors": len(self.cursors.held)}

    def transactions(self) -> list[dict]:
        now = time.monotonic()
        return [{"id": t.id, "read_ts": t.read_ts, "idle_s": round(now - t.began, 3), "staged": sorted({*t.puts, *t.deletes})} for t in self.active]

    def check(self) -> list[str]:
        """What is wrong with the store's folder: parts that the pointer names and aren't there, or that it doesn't name, and the like."""
        return self.store.check(set(self.catalog.schemas))

    # ------------------------------------------------------------------ writes

    def begin(self) -> Transaction:
        txn = Transaction(self.store.state["ts"], time.monotonic())
        self.active.append(txn)
        return txn

    def rollback(self, txn: Transaction) -> None:
        txn.open = False
        self.active = [t for t in self.active if t is not txn]
        if self.store is not None:
            self.files.remove(f"{self.store.path}/staged/{txn.id}")

    def apply(self, data: dict) -> dict:
        """One mutation as a transaction of its own."""
        with self.metrics.timed(str(data.get("mutation"))):
            txn = self.begin()
            try:
                result = self.stage(txn, data, strict=True)
                self.commit(txn)
            finally:
                self.rollback(txn)
            for name in ("inserted", "updated", "deleted"):
                self.metrics.add(f"records_{name}", result[name])
            return result

    def _records(self, m: ir.Mutation, schema: Schema) -> DataFrame:
        empty, _ = Engine.frame(self, m.collection, as_of=-1)
        types = {f.name: f.dataType for f in empty.schema.fields}
        known = [f.name for f in schema.fields] + [x.name for x in schema.links]
        for r in m.records:
            for f in schema.fields:
                if (f.primary_key or not f.nullable) and r.get(f.name) is None:
                    raise EngineError("schema_violation", f"{f.name} is required")
                v = r.get(f.name)
                if v is not None and not _fits(f, v):
                    raise EngineError("schema_violation", f"{f.name} isn't a {f.type}")
        from pyspark.sql.types import ArrayType, StringType, StructField, StructType, VariantType

        def plain(name: str):
            return StringType() if isinstance(types.get(name), VariantType) else types.get(name) or (ArrayType(StringType()) if any(x.name == name and x.cardinality != "to_one" for x in schema.links) else StringType())

        import json

        rows = [tuple([str(r[schema.key]) if schema.key else uuid.uuid4().hex] + [json.dumps(r[n]) if isinstance(r.get(n), dict) else r.get(n) for n in known]) for r in m.records]
        df = self.spark.createDataFrame(rows, StructType([StructField("record_id", StringType()), *[StructField(n, plain(n)) for n in known]]))
        for n in known:
            if isinstance(types.get(n), VariantType):
                df = df.withColumn(n, F.try_parse_json(F.col(n)))
        return df

    def stage(self, txn: Transaction, data: dict, strict: bool = False) -> dict:
        """Checks a mutation against what the transaction sees, and holds it until the commit."""
        self._check_open(txn)
        m = ir.read_mutation(data)
        schema = self.catalog.get(m.collection)
        seen, key = self.frame(m.collection, txn=txn)
        if m.kind in ("insert", "bulk_insert", "upsert"):
            ids = [str(r[schema.key]) for r in m.records if schema.key in r] if schema.key else []
            records = self._records(m, schema)
            there = {r[0] for r in seen.filter(F.col("record_id").isin(ids)).select("record_id").collect()} if ids else set()
            if len(set(ids)) < len(ids) or strict and m.kind != "upsert" and there:
                raise EngineError("unique_violation", f"{schema.key} is taken")
            for f in schema.fields:
                if f.unique and not f.primary_key and (not versions.duplicate_values(records, f.name).isEmpty() or not versions.taken(records, seen, f.name).isEmpty()):
                    raise EngineError("unique_violation", f"{f.name} is taken")
            self._check_links(records, schema, txn)
            self._put(txn, m.collection, records)
            return {"inserted": len(m.records) - len(there), "updated": len(there), "deleted": 0, "ids": ids}
        hit = condition(seen, m.filter, True)
        rows = seen.filter(hit)
        n = rows.count()
        if m.kind == "delete":
            for other in self.catalog.schemas.values():
                for link in other.links:
                    if link.target == m.collection and link.on_delete == "restrict" and not versions.referred(rows, key, self._keys(other.name, link, txn), "k").isEmpty():
                        raise EngineError("conflict", f"'{other.name}' links to records to be deleted")
            gone = self._held(rows.select("record_id"), txn)
            txn.deletes[m.collection] = gone.unionByName(txn.deletes[m.collection]) if m.collection in txn.deletes else gone
            if m.collection in txn.puts:
                txn.puts[m.collection] = txn.puts[m.collection].join(gone, "record_id", "left_anti")
            return {"inserted": 0, "updated": 0, "deleted": n}
        if schema.key in m.set:
            raise invalid("the primary key can't be changed")
        unique = [f.name for f in schema.fields if f.unique and f.name in m.set]
        changed = self._held(versions.updated(rows, F.lit(True), {c: F.lit(v).cast(dict(seen.dtypes)[c]) if c in seen.columns else F.lit(v) for c, v in m.set.items()}), txn)
        if unique and (n > 1 or any(not versions.taken(changed, seen, u).isEmpty() for u in unique)):
            raise EngineError("unique_violation", f"{unique} is taken")
        if not changed.filter(schema.violation(changed).isNotNull()).isEmpty():
            raise EngineError("schema_violation", "an updated record breaks the schema")
        self._check_links(changed, schema, txn)
        self._put(txn, m.collection, changed)
        return {"inserted": 0, "updated": n, "deleted": 0}

    def _keys(self, name: str, link: Link, txn: Transaction | None) -> DataFrame:
        df, _ = self.frame(name, txn=txn)
        return df.select((F.col(link.name) if link.cardinality == "to_one" else F.explode(link.name)).alias("k"))

    def _check_links(self, records: DataFrame, schema: Schema, txn: Transaction) -> None:
        for link in schema.links:
            target, key = self.frame(link.target, txn=txn)
            if link.target == schema.name:
                target = target.unionByName(records, allowMissingColumns=True)
            keys = records.select((F.col(link.name) if link.cardinality == "to_one" else F.explode(link.name)).alias("k"))
            if not versions.dangling(keys, "k", target, key).isEmpty():
                raise EngineError("conflict", f"'{link.name}' names a record that isn't there")

    def _put(self, txn: Transaction, name: str, records: DataFrame) -> None:
        if name in txn.puts:
            records = versions.upserted(txn.puts[name], records)
        if name in txn.deletes:
            txn.deletes[name] = txn.deletes[name].join(records, "record_id", "left_anti")
        txn.puts[name] = records

    def _held(self, df: DataFrame, txn: Transaction) -> DataFrame:
        """Staged rows as they are now, on disk until the transaction ends: they must not change with what is committed later."""
        part = f"{self.store.path}/staged/{txn.id}/{uuid.uuid4().hex}"
        df.write.parquet(part)
        return self.spark.read.parquet(part)

    def _check_open(self, txn: Transaction) -> None:
        if not txn.open:
            raise EngineError("conflict", "the transaction has ended")
        if time.monotonic() - txn.began > self.idle_timeout_s:
            self.rollback(txn)
            raise EngineError("transaction_timeout", "the transaction was idle for too long")
        txn.began = time.monotonic()

    def reap(self) -> int:
        """Rolls back the transactions, and closes the cursors, that were idle for too long; how many."""
        late = [t for t in self.active if time.monotonic() - t.began > self.idle_timeout_s]
        for t in late:
            self.rollback(t)
        return len(late) + self.cursors.reap()

    def commit(self, txn: Transaction) -> int:
        """First committer wins; unique values and links are checked again against what is there now."""
        self._check_open(txn)
        try:
            with self.store.lock:
                names = set(txn.puts) | set(txn.deletes)
                moved = self.store.state["ts"] > txn.read_ts
                for name in names:
                    log = self.store.log(name)
                    written = [df.select("record_id") for df in (txn.puts.get(name), txn.deletes.get(name)) if df is not None]
                    if log is not None and not versions.conflicts(log, reduce(DataFrame.unionByName, written), txn.read_ts).isEmpty():
                        raise EngineError("conflict", f"records of '{name}' were changed meanwhile")
                    if name in txn.puts and moved:
                        now = self.frame(name)[0].join(reduce(DataFrame.unionByName, written), "record_id", "left_anti")
                        for f in self.catalog.get(name).fields:
                            if f.unique and not versions.taken(txn.puts[name], now, f.name).isEmpty():
                                raise EngineError("unique_violation", f"{f.name} is taken")
                if moved:
                    self._check_links_now(txn, names)
                ts = self.store.commit({n: (txn.puts.get(n), txn.deletes.get(n)) for n in names}) if names else self.store.state["ts"]
        finally:
            self.rollback(txn)
        self.cells.clear()
        return ts

    def _check_links_now(self, txn: Transaction, names: set[str]) -> None:
        """Links of and to what a transaction wrote, against what others have committed since it began."""
        now = replace(txn, read_ts=self.store.state["ts"])
        for name in names:
            if name in txn.puts:
                self._check_links(txn.puts[name], self.catalog.get(name), now)
        for schema in self.catalog.schemas.values():
            for link in schema.links:
                if link.target in txn.deletes and link.on_delete == "restrict":
                    target, key = self.frame(link.target, txn=now)
                    if not versions.dangling(self._keys(schema.name, link, now), "k", target, key).isEmpty():
                        raise EngineError("conflict", f"'{schema.name}' links to records that were deleted")

    def compact(self, name: str) -> int:
        """The log of a collection in few files, as many versions as before; how many."""
        return self.store.compact(name)

    def gc(self, name: str, keep: int = 1, dry_run: bool = False) -> tuple[int, int]:
        """Versions before and after; none that an open transaction may read is dropped."""
        cutoff = min([t.read_ts for t in self.active], default=self.store.state["ts"])
        return self.store.gc(name, cutoff, keep, dry_run)


@dataclass
class Held:
    rows: DataFrame
    q: ir.Find
    key: str
    txn: Transaction | None
    ts: int | None
    size: int
    used: float
    done: int = 0


class Cursors:
    """Results that are held for paging: rows of key and rank, written to the shared folder, and how far each was read."""

    def __init__(self, idle_timeout_s: float):
        self.idle_timeout_s, self.held = idle_timeout_s, {}

    def open(self, rows: DataFrame, q: ir.Find, key: str, txn: Transaction | None, ts: int | None) -> str:
        name = uuid.uuid4().hex
        self.held[name] = Held(rows, q, key, txn, ts, rows.count(), time.monotonic())
        return name

    def at(self, name: str) -> Held:
        self.reap()
        if name not in self.held:
            raise EngineError("not_found", "no such cursor: it was closed, exhausted or idle for too long")
        self.held[name].used = time.monotonic()
        return self.held[name]

    def advance(self, name: str, n: int) -> bool:
        held = self.held[name]
        held.done += n
        if held.done >= held.size:
            self.close(name)
        return held.done < held.size

    def close(self, name: str) -> bool:
        return self.held.pop(name, None) is not None

    def reap(self) -> int:
        late = [n for n, h in self.held.items() if time.monotonic() - h.used > self.idle_timeout_s]
        for n in late:
            self.close(n)
        return len(late)


def _fits(f: FieldDef, v) -> bool:
    kinds = {"uuid": str, "string": str, "int": int, "float": (int, float), "bool": bool, "document": dict, "bytes": (bytes, bytearray), "timestamp": object}
    if f.type == "vector":
        return isinstance(v, list) and len(v) == f.dim
    return isinstance(v, kinds[f.type]) and not (isinstance(v, bool) and f.type in ("int", "float"))
