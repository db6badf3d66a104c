"""Nearest vectors: exact, in batches, and approximate with an exact re-rank."""

from __future__ import annotations

import base64
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import EngineError, invalid
from siltstone.functions.vectors import metric_of
from siltstone.sources.files import Files, shared_dir, version_of

#: Fewer vectors than this are always searched exactly.
ANN_LEAST = 16
#: Cells are probed until at most ``MISSED`` of the sampled queries have less than ``RECALL`` of their exact neighbours.
RECALL, MISSED = 0.9, 0.01
#: Vectors on which the probes are measured, and cells, at most.
SAMPLE, MOST = 4000, 4096
#: Vectors in a block of a search in which every row is a query.
BLOCK = 2048


def exact(df: DataFrame, key: str, column: str, query: list[float], k: int, metric: str | None = None) -> DataFrame:
    """(key, score) of the best ``k`` vectors as long as the query, ties by key.

    Arrow batches are scored as matrix products; a task hands on its best ``k`` only.
    """
    name, asked, size = metric_of(metric), np.array([query], dtype=np.float64), len(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            if not rows.num_rows:
                continue
            score = _similarities(rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64), asked, name)[:, 0]
            own = pa.table([rows.column(0), pa.array(score), pa.array(np.round(score, 9) + 0.0)], names=["key", "score", "level"])
            if len(score) > k:  # all that may be among the best, ties included
                least = np.partition(score, len(score) - k)[len(score) - k] if k else np.inf
                own = own.filter(pa.array(score >= least - 2e-9))
            held = own if held is None else pa.concat_tables([held, own])
            held = held.take(pc.sort_indices(held, sort_keys=[("level", "descending"), ("key", "ascending")])[:k])
        if held is not None:
            yield from pa.table([held.column("key"), held.column("score")], names=[key, "score"]).to_batches()

    shape = T.StructType([df.schema[key], T.StructField("score", T.DoubleType())])
    best = df.filter(F.size(column) == size).select(key, column).mapInArrow(run, shape)
    return best.orderBy(F.round("score", 9).desc(), key).limit(k)


def check_dimension(query: list[float], dim: int | None) -> None:
    if dim is not None and len(query) != dim:
        raise invalid(f"the query vector must have {dim} numbers")


def _similarities(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return vectors @ queries.T
    if metric == "euclidean":
        square = (vectors**2).sum(1)[:, None] - 2 * vectors @ queries.T + (queries**2).sum(1)[None]
        return -np.sqrt(np.maximum(square, 0))
    norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None]
    return np.divide(vectors @ queries.T, norms, out=np.zeros((len(vectors), len(queries))), where=norms > 0)


def batch(df: DataFrame, key: str, column: str, queries: dict[int, list[float]], k: int, metric: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): each Arrow batch is one matrix product, and keeps its best ``k`` of each query."""
    ids, name = list(queries), metric_of(metric)
    wanted = df.sparkSession.sparkContext.broadcast(np.array([queries[i] for i in ids], dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            vectors = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1).astype(np.float64)
            score = _similarities(vectors, wanted.value, name)
            order = np.lexsort((np.broadcast_to(keys[:, None], score.shape).T, -np.round(score.T, 9)))[:, :k]
            n = order.shape[1]
            yield pa.record_batch(
                [pa.array(np.repeat(ids, n).astype(np.int64)), pa.array(keys[order].ravel()), pa.array(np.take_along_axis(score.T, order, 1).ravel())], names=["query_id", key, "score"]
            )

    best = df.filter(F.size(column) == wanted.value.shape[1]).select(key, column).mapInArrow(run, f"query_id bigint, {key} bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def _blocks(size: int):
    """(dim, keys, vectors): at most ``size`` vectors of one length in a row, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(dim: int, n: int) -> pa.RecordBatch:
            keys, vectors = (np.concatenate(x) for x in zip(*held[dim], strict=True))
            held[dim] = [(keys[n:], vectors[n:])]
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([keys[:n].tobytes()], pa.binary()), pa.array([vectors[:n].tobytes()], pa.binary())], names=["dim", "keys", "vectors"])

        for rows in batches:
            sizes = pc.list_value_length(rows.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                own = rows.filter(pa.array(sizes == dim))
                vectors = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                held.setdefault(int(dim), []).append((own.column(0).to_numpy(zero_copy_only=False).astype(np.int64), vectors))
                while sum(len(k) for k, _ in held[dim]) >= size:
                    yield row(int(dim), size)
        for dim, parts in held.items():
            if n := sum(len(k) for k, _ in parts):
                yield row(dim, n)

    return run


def every(df: DataFrame, key: str, column: str, k: int, metric: str | None = None, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` for every row of ``queries`` (by default of all rows) as a query.

    Blocks of queries meet blocks of vectors, one matrix product each, of which the best ``k`` of each query
    are kept; nothing goes through the driver. Vectors only meet those as long as they are; rows without a
    key or vector are left out, and a key is expected once.
    """
    name, spark = metric_of(metric), df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in batches:
            for dim, ids, asked, other, keys, vectors in zip(*(pairs.column(c) for c in ("dim", "ids", "asked", "other", "keys", "vectors")), strict=True):
                if dim != other:
                    continue
                ids, keys = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (ids, keys))
                asked, vectors = (np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, dim.as_py()) for x in (asked, vectors))
                score = _similarities(asked, vectors, name)
                n = min(k, len(keys))
                least = np.partition(score, len(keys) - n, axis=1)[:, len(keys) - n]
                q, v = np.nonzero(score >= least[:, None] - 2e-9)  # all that may tie with the last at nine decimals
                found = score[q, v]
                order = np.lexsort((keys[v], -np.round(found, 9), q))
                q, v, found = q[order], v[order], found[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.record_batch([pa.array(ids[q[kept]]), pa.array(keys[v[kept]]), pa.array(found[kept])], names=["query_id", key, "score"])

    def packed(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(key).isNotNull() & (F.size(column) > 0)).select(key, column).mapInArrow(_blocks(block), "dim int, keys binary, vectors binary")

    # few partitions, so that blocks are full and each is sent to few tasks
    parts = max(1, int(spark.sparkContext.defaultParallelism))
    blocks = packed(df)
    left = (blocks if queries is None else packed(queries)).toDF("dim", "ids", "asked").repartition(parts)
    pairs = left.crossJoin(blocks.withColumnRenamed("dim", "other").repartition(parts))
    best = pairs.mapInArrow(run, f"query_id bigint, {key} bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def mode(asked: dict | None, vectors: int) -> str:
    """exact, ann_preview or exact_fallback."""
    if asked is None:
        return "exact"
    if vectors >= ANN_LEAST:
        return "ann_preview"
    if asked.get("fallback", "exact") == "error":
        raise EngineError("unsupported", f"fewer than {ANN_LEAST} vectors")
    return "exact_fallback"


class Cells:
    """An inverted-file index: centres of a bounded sample of the vectors; each vector belongs to its nearest.

    There are about as many cells as the root of the number of vectors. The vectors are stored by cell, so
    that a search reads the files of the cells that it probes; all of them are indexed.
    """

    def __init__(self, df: DataFrame, column: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 4):
        n = df.count()
        cells = cells or max(32, min(MOST, math.isqrt(n)))
        sample = max(sample, 32 * cells)
        rows = df.select(column).filter(F.col(column).isNotNull()).sample(fraction=min(1.0, 1.2 * sample / max(n, 1)), seed=seed).limit(sample).collect()
        if not rows:
            raise EngineError("unsupported", "there are no vectors")
        points = np.array([r[0] for r in rows], dtype=np.float64)
        self.points, self.measured = points[:SAMPLE].copy(), {}
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        self.centres = points[rng.permutation(len(points))[: min(cells, len(points))]]
        for _ in range(12):
            own = (points @ self.centres.T).argmax(1)
            for c in range(len(self.centres)):
                if (own == c).any():
                    mean = points[own == c].mean(0)
                    self.centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
        self.stored: DataFrame | None = None

    @classmethod
    def opened(cls, df: DataFrame, key: str, column: str, folder: str | None = None) -> Cells:
        """The cells of a column with its vectors stored by cell: those kept for this content, or made and kept now."""
        spark, files, version = df.sparkSession, Files(df.sparkSession), version_of(df.select(key, column))
        base = folder or shared_dir(spark) + "/cells"
        pointer = f"{base}/{version}-{column}.path"
        path = files.read(pointer) if version else None
        if path is not None:
            m = json.loads(files.read(f"{path}/manifest.json"))
            cells = cls.__new__(cls)
            cells.centres, cells.points = (np.frombuffer(base64.b64decode(m[x]), dtype=np.float64).reshape(-1, m["dim"]).copy() for x in ("centres", "points"))
            cells.measured = {(k, name): n for k, name, n in json.loads(files.read(f"{path}/measured.json") or "[]")}
        else:
            path, cells = f"{base}/{uuid.uuid4().hex}", cls(df, column)
            usable = df.select(key, column).filter(F.size(column) == cells.centres.shape[1])
            cells.assigned(usable, column).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
            packed = {x: base64.b64encode(np.ascontiguousarray(getattr(cells, x)).tobytes()).decode() for x in ("centres", "points")}
            files.replace(f"{path}/manifest.json", json.dumps(packed | {"dim": int(cells.centres.shape[-1])}))
            if version:  # put there last, so that those who make the same don't meet
                files.replace(pointer, path)
        cells.path = path
        cells.stored = spark.read.schema(T.StructType([df.schema[key], df.schema[column], T.StructField("cell", T.IntegerType())])).parquet(f"{path}/vectors")
        return cells

    def search(self, key: str, column: str, query: list[float], k: int, metric: str | None = None) -> DataFrame:
        """The best ``k`` of the stored vectors, as far as they are in the cells that are probed; scored exactly."""
        return self.nearest(self.stored, key, column, query, k, metric)

    def assigned(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the cell of each vector, by which a table can be partitioned."""
        centres = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("int")
        def cell(vectors):
            import pandas as pd

            return pd.Series((np.array(vectors.tolist(), dtype=np.float64) @ centres.value.T).argmax(1))

        return df.withColumn("cell", cell(F.col(column)))

    def probes(self, k: int, metric: str | None = None) -> int:
        """Cells to probe for ``k`` neighbours, as measured on the sample; all where nothing less will do.

        Up to about 2000 sampled vectors are queries, and their exact neighbours are those in the sample; of a larger
        table it is an estimate.
        """
        name = metric_of(metric)
        if (k, name) not in self.measured:
            n, cells = min(k, len(self.points)), len(self.centres)
            own = (self.points @ self.centres.T).argmax(1)
            short = np.zeros(cells, dtype=np.int64)  # queries below RECALL with so many cells, less one
            asked = self.points[:: max(1, len(self.points) // 1000)]
            for begin in range(0, len(asked), 250):
                queries = asked[begin : begin + 250]
                best = np.argsort(-_similarities(queries, self.points, name), axis=1, kind="stable")[:, :n]
                place = np.argsort(np.argsort(-(queries @ self.centres.T), axis=1), axis=1)
                probe = np.take_along_axis(place, own[best], axis=1)
                # hits needed, in order of the probe that finds them: the last needed one is the probe that suffices
                needed = np.sort(probe, axis=1)[:, max(1, int(np.ceil(RECALL * n - 1e-9))) - 1]
                short += (needed[:, None] > np.arange(cells)).sum(0)
            self.measured[k, name] = int(np.argmax(short <= MISSED * len(asked))) + 1
            if self.stored is not None:
                Files(self.stored.sparkSession).replace(f"{self.path}/measured.json", json.dumps([[*at, n] for at, n in self.measured.items()]))
        return self.measured[k, name]

    def near(self, query: list[float], k: int, metric: str | None = None, probes: int | None = None) -> list[int]:
        """The cells to search, nearest first."""
        return np.argsort(-(self.centres @ np.asarray(query, dtype=np.float64)))[: probes or self.probes(k, metric)].tolist()

    def nearest(self, assigned: DataFrame, key: str, column: str, query: list[float], k: int, metric: str | None = None, probes: int | None = None) -> DataFrame:
        """The best ``k`` among the vectors of the cells nearest to the query, scored exactly."""
        return exact(assigned.filter(F.col("cell").isin(self.near(query, k, metric, probes))), key, column, query, k, metric)
