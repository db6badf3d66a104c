"""Vector searches over all rows as queries against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from siltstone.operators import nearest


def vectors(n: int, dim: int, seed: int) -> list[tuple[int, list[float]]]:
    return [(3 * i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, dim)))]


def plain(rows, k: int, metric: str) -> set[tuple[int, int, int]]:
    """(query_id, vec_id, rank), one pair at a time."""
    out = set()
    for q, a in rows:
        found = []
        for key, b in rows:
            x, y = np.array(a), np.array(b)
            if len(x) == len(y):
                score = {"cosine": lambda: x @ y / (np.linalg.norm(x) * np.linalg.norm(y)), "dot_product": lambda: x @ y, "l2": lambda: -np.linalg.norm(x - y)}[metric]()  # noqa: B023
                found.append((-round(float(score), 9) + 0.0, key))
        out |= {(q, key, rank) for rank, (_, key) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot_product"])
def test_every_row_is_a_query(spark, metric):
    rows = vectors(90, 6, 1) + [(1000 + i, v) for i, (_, v) in enumerate(vectors(7, 3, 2))]
    rows += [(2000 + i, rows[5][1]) for i in range(14)]  # ties beyond k
    df = spark.createDataFrame([*rows, (3000, None), (None, rows[0][1])], "vec_id bigint, embedding array<double>")
    got = nearest.every(df, "vec_id", "embedding", 10, metric, block=16).collect()
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == plain(rows, 10, metric)
    assert len({r["query_id"] for r in got}) == len(rows)


def test_a_query_set_meets_all_rows(spark):
    rows = vectors(60, 5, 3)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest.every(df, "vec_id", "embedding", 10, block=16, queries=df.filter("vec_id % 20 = 0")).collect()
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == {x for x in plain(rows, 10, "cosine") if x[0] % 20 == 0}


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot_product"])
@pytest.mark.parametrize("k", [1, 10, 500])
def test_one_query_gets_the_best_of_all_partitions(spark, metric, k):
    rows = [*vectors(90, 6, 1), *((2000 + i, vectors(90, 6, 1)[5][1]) for i in range(14))]
    df = spark.createDataFrame([*rows, (3000, None), (3001, [1.0])], "vec_id bigint, embedding array<double>").repartition(7)
    got = [r["vec_id"] for r in nearest.exact(df, "vec_id", "embedding", rows[5][1], k, metric).collect()]
    assert got == [key for _, key, _ in sorted((x for x in plain(rows, k, metric) if x[0] == rows[5][0]), key=lambda x: x[2])]
    if metric != "dot_product" and k == 10:  # keys of any type
        named = df.select(df["vec_id"].cast("string").alias("name"), "embedding")
        assert [r[0] for r in nearest.exact(named, "name", "embedding", rows[5][1], 3, metric).collect()] == ["15", "2000", "2001"]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot_product"])
def test_cells_hold_the_exact_neighbours(spark, small, metric):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    cells = nearest.Cells(df, "embedding")
    assigned = cells.assigned(df, "embedding")
    rows = {r["vec_id"]: r for r in assigned.collect()}
    recall: dict[int, float] = dict.fromkeys(rows, 0.0)
    for r in nearest.every(df, "vec_id", "embedding", 10, metric).collect():
        recall[r["query_id"]] += (rows[r["vec_id"]]["cell"] in cells.near(rows[r["query_id"]]["embedding"], 10, metric)) / 10
    assert np.mean(list(recall.values())) >= 0.9
    assert np.mean([r < 0.9 - 1e-9 for r in recall.values()]) <= 0.01
    for q in (0, 1, 2):  # what the cells hold is found, and by every() what exact() finds
        asked = rows[q]["embedding"]
        want = {r["vec_id"] for r in nearest.exact(df, "vec_id", "embedding", asked, 10, metric).collect()}
        got = {r["vec_id"] for r in cells.nearest(assigned, "vec_id", "embedding", asked, 10, metric).collect()}
        assert len(got & want) / 10 == pytest.approx(recall[q]) and len(got) == 10
