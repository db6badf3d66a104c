"""Collections as version logs: appended Parquet, and a pointer file that names what counts.

A commit writes its versions to a folder of its own and then replaces the pointer, so it is seen
whole or not at all. Commits are made one at a time by the driver that owns the store. Folders are on
whatever file system the path names; on a cluster, one that all executors share.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.operators import versions
from siltstone.sources.files import Files

#: Bytes in a file of a compacted log, about.
FILE_BYTES = 128 << 20


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock, self.files = spark, path.rstrip("/"), threading.RLock(), Files(spark)
        self.pointer = f"{self.path}/current.json"
        held = self.files.read(self.pointer)
        self.state = json.loads(held) if held else {"ts": 0, "logs": {}}

    def _replace(self, state: dict) -> None:
        self.files.replace(self.pointer, json.dumps(state))
        self.state = state

    def log(self, name: str) -> DataFrame | None:
        parts = self.state["logs"].get(name)
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None

    def read(self, name: str, as_of: int | None = None) -> DataFrame | None:
        log = self.log(name)
        return None if log is None else versions.snapshot(log, as_of)

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], mark: tuple[str, int] | None = None) -> int:
        """Puts and deletes (by record_id) of some collections, all under one new timestamp.

        ``mark`` is a stream and the number of its batch: one that was committed before isn't again.
        """
        with self.lock:
            streams = dict(self.state.get("streams", {}))
            if mark is not None:
                if streams.get(mark[0], -1) >= mark[1]:
                    return self.state["ts"]
                streams[mark[0]] = mark[1]
            ts, logs = self.state["ts"] + 1, {k: list(v) for k, v in self.state["logs"].items()}
            for name, (puts, deletes) in changes.items():
                for df, gone in ((puts, False), (deletes, True)):
                    if df is None:
                        continue
                    part = f"{name}/{ts}-{uuid.uuid4().hex}"
                    df.drop("commit_ts", "deleted").withColumn("commit_ts", F.lit(ts).cast("bigint")).withColumn("deleted", F.lit(gone)).write.parquet(f"{self.path}/{part}")
                    logs.setdefault(name, []).append(part)
            self._replace(self.state | {"ts": ts, "logs": logs, "streams": streams})
            return ts

    def rewrite(self, name: str, df: DataFrame) -> None:
        """Another log in place of the one there is: for garbage collection and compaction."""
        with self.lock:
            part, old = f"{name}/{self.state['ts']}-{uuid.uuid4().hex}", self.state["logs"].get(name, [])
            df.write.parquet(f"{self.path}/{part}")
            self._replace(self.state | {"logs": self.state["logs"] | {name: [part]}})
            for p in old:
                self.files.remove(f"{self.path}/{p}")

    def compact(self, name: str) -> int:
        """One folder of files of about ``FILE_BYTES``, ordered by record, for the folders of all commits; the number of versions."""
        with self.lock:
            log = self.log(name)
            if log is None:
                return 0
            size = sum(n for p in self.state["logs"][name] for _, n, _ in self.files.names(f"{self.path}/{p}"))
            self.rewrite(name, log.repartitionByRange(max(1, -(-size // FILE_BYTES)), "record_id").sortWithinPartitions("record_id", "commit_ts"))
            return self.log(name).count()

    def gc(self, name: str, cutoff: int, keep: int = 1, dry_run: bool = False) -> tuple[int, int]:
        """(versions before, versions kept)."""
        log = self.log(name)
        kept = versions.survivors(log, cutoff, keep)
        counts = log.count(), kept.count()
        if not dry_run and counts[0] != counts[1]:
            self.rewrite(name, kept)
        return counts

    def check(self, known: set[str]) -> list[str]:
        """What is wrong with the folder, a line each; nothing is changed."""
        found = []
        for name, parts in self.state["logs"].items():
            if name not in known:
                found.append(f"'{name}' has a log and no schema")
            found += [f"{p} is named and isn't complete" for p in parts if not self.files.exists(f"{self.path}/{p}/_SUCCESS")]
            found += [f"{name}/{n} isn't named by the pointer" for n, _, _ in self.files.names(f"{self.path}/{name}") if f"{name}/{n}" not in parts]
        for folder, _, _ in self.files.names(f"{self.path}/indexes"):
            for ts, _, _ in self.files.names(f"{self.path}/indexes/{folder}"):
                if not self.files.exists(f"{self.path}/indexes/{folder}/{ts}/manifest.json"):
                    found.append(f"indexes/{folder}/{ts} has no manifest")
        if self.files.read(f"{self.path}/catalog.json") is None and known:
            found.append("there is no catalog")
        return found

    def snapshot_to(self, folder: str) -> None:
        """A portable copy of all that is visible now; it counts once its manifest is written."""
        counts = {}
        for name in self.state["logs"]:
            self.read(name).write.mode("overwrite").parquet(f"{folder}/{name}")
            counts[name] = self.spark.read.parquet(f"{folder}/{name}").count()
        self.files.replace(f"{folder}/manifest.json", json.dumps({"ts": self.state["ts"], "collections": counts}))

    def inspect(self, folder: str) -> dict:
        """The manifest of a snapshot: when it was made, and how many records each collection has."""
        held = self.files.read(f"{folder}/manifest.json")
        if held is None:
            raise EngineError("not_found", "no snapshot there")
        return json.loads(held)

    def restore_from(self, folder: str) -> int:
        found = self.inspect(folder)["collections"]
        frames = {n: self.spark.read.parquet(f"{folder}/{n}") for n in found}
        if bad := [n for n, df in frames.items() if df.count() != found[n]]:
            raise EngineError("corruption", f"{bad} don't have the records that the manifest says")
        return self.commit({n: (df, None) for n, df in frames.items()})
