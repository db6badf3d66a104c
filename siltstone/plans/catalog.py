"""Collections: a DataFrame, its primary key, declared fields, links and indexes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import EngineError, invalid
from siltstone.sources.files import Files

TYPES = {"uuid": "string", "string": "string", "int": "bigint", "float": "double", "bool": "boolean", "timestamp": "timestamp", "document": "variant", "bytes": "binary", "vector": "array<float>"}


@dataclass
class Link:
    name: str
    target: str
    cardinality: str = "to_one"
    on_delete: str = "restrict"


@dataclass
class FieldDef:
    name: str
    type: str
    primary_key: bool = False
    unique: bool = False
    nullable: bool = True
    indexed: bool = False
    dim: int | None = None


@dataclass
class Schema:
    name: str
    fields: list[FieldDef]
    links: list[Link] = field(default_factory=list)
    full_text: list[str] = field(default_factory=list)
    document_paths: list[str] = field(default_factory=list)

    @property
    def key(self) -> str | None:
        return next((f.name for f in self.fields if f.primary_key), None)

    def field(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    def check(self) -> Schema:
        """The definition itself: a name, one key at most, known types, and indexes on fields that suit them."""
        if not self.name:
            raise invalid("a collection needs a name")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names) or {x.name for x in self.links} & set(names):
            raise invalid("names of fields and links must differ")
        if sum(f.primary_key for f in self.fields) > 1:
            raise invalid("there can be one primary key")
        if bad := [f.name for f in self.fields if f.type not in TYPES or f.type == "vector" and not f.dim]:
            raise invalid(f"unknown type of {bad}")
        for name in self.full_text:
            if "." in name or (f := self.field(name)) is None or f.type != "string":
                raise invalid(f"full text needs a string field, not '{name}'")
        for path in self.document_paths:
            root = self.field(path.split(".")[0])
            if root is None or "." in path and root.type != "document":
                raise invalid(f"'{path}' isn't within a document")
        return self

    def violation(self, df: DataFrame) -> Column:
        """The first rule that a row breaks, or null: required fields and vector lengths (column types hold the rest)."""
        test = F.lit(None).cast("string")
        for f in reversed(self.fields):
            if f.name not in df.columns:
                if f.primary_key or not f.nullable:
                    test = F.lit(f"{f.name} is required")
                continue
            if f.type == "vector":
                test = F.when(F.col(f.name).isNotNull() & (F.size(f.name) != f.dim), F.lit(f"{f.name} must have {f.dim} numbers")).otherwise(test)
            if f.primary_key or not f.nullable:
                test = F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is required")).otherwise(test)
        return test


class Catalog:
    """Schemas by name; kept in a JSON file if a path is given."""

    def __init__(self, path: str | None = None, files: Files | None = None):
        self.path, self.files, self.schemas = path, files, {}
        if path and (held := files.read(path)):
            self.schemas = {s["name"]: load(s) for s in json.loads(held)}

    def create(self, schema: Schema) -> None:
        if schema.name in self.schemas:
            raise EngineError("conflict", f"'{schema.name}' is there already")
        self.schemas[schema.name] = schema.check()
        self._save()

    def drop(self, name: str) -> None:
        self.get(name)
        users = [s.name for s in self.schemas.values() if s.name != name and any(x.target == name for x in s.links)]
        if users:
            raise EngineError("conflict", f"{users} link to '{name}'")
        del self.schemas[name]
        self._save()

    def get(self, name: str) -> Schema:
        if name not in self.schemas:
            raise EngineError("not_found", f"no collection '{name}'")
        return self.schemas[name]

    def _save(self) -> None:
        if self.path:
            self.files.replace(self.path, json.dumps([asdict(s) for s in self.schemas.values()]))


def load(data: dict) -> Schema:
    return Schema(data["name"], [FieldDef(**f) for f in data["fields"]], [Link(**x) for x in data.get("links", [])], data.get("full_text", []), data.get("document_paths", []))
