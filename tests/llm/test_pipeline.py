"""The pipeline against the plain versions of its stages, on a small corpus with odd rows."""

from __future__ import annotations

import random

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, x int, y int, leaked_id int, own int"


def corpus():
    rng = random.Random(5)
    words = {"en": "the of and house garden with this that from where people".split(), "de": "der die und haus garten mit dieser das von wo leute".split()}
    texts = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        texts.append((k, "\n".join(" ".join(f"{rng.choice(words[lang])} {rng.choice(words[lang])}{rng.randrange(500)}" for _ in range(12)) for _ in range(6)), lang))
    shared = "\n".join(f"shared line {k} of the and people" for k in range(4))
    texts += [(100, texts[0][1], "en"), (101, texts[1][1] + " more", "de"), (102, texts[4][1] + "\n" + shared, "en"), (103, texts[6][1] + "\n" + shared, "en")]
    texts += [(104, None, "en"), (105, "", "en"), (None, texts[8][1], "en"), (None, "garden where people " * 30, "en"), (10, texts[10][1], "en"), (10, texts[10][1], "en")]
    items = [(1, " ".join(texts[20][1].split()[5:40])), (2, "nothing that is there at all, whatever one looks for in here"), (3, None)]
    return [(d, t, g, "s", len(t or ""), 1, 2, 3, 4) for d, t, g in texts], items


def kept_near(rows):
    """Of each group of texts the row with the smallest doc_id; named by place."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    group = brute.near_groups(numbered)
    best: dict[int, int] = {}
    for k, g in group.items():
        if g not in best or (rows[k][0] is None, rows[k][0] or 0, k) < (rows[best[g]][0] is None, rows[best[g]][0] or 0, best[g]):
            best[g] = k
    return sorted((rows[k] for k in range(len(rows)) if k not in group or best[group[k]] == k), key=repr)


def test_stages_are_those_of_the_plain_versions(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]

    def after(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or out.columns == docs.columns
        return out

    first = after("language_id", docs)
    held = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert all(t for _, t in held) and len(held) >= 0.95 * sum(bool(r[1]) for r in rows)

    second = after("line_dedup", first)
    once = list(dict.fromkeys(held))  # rows that are equal count once
    want = {r: (d, t) for r, (d, t, _) in zip(once, brute.line_dedup(once), strict=True)}
    got = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert sorted(got, key=repr) == sorted((want[r] for r in held if want[r][1].strip(" ")), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect()) and sum(len(t) for _, t in got) < sum(len(t) for _, t in held)

    third = after("simhash_dedup", second)
    assert sorted(((r["doc_id"], r["text"]) for r in third.collect()), key=repr) == kept_near(got)
    assert third.count() < second.count()

    fourth = after("decontamination", third)
    kept = [(r["doc_id"], r["text"]) for r in third.collect()]
    leaked = {d for d, _ in brute.leaks([(k, t) for k, (_, t) in enumerate(kept)], items)}
    assert sorted(((r["doc_id"], r["text"]) for r in fourth.collect()), key=repr) == sorted((r for k, r in enumerate(kept) if k not in leaked), key=repr) and leaked

    packed = after("packing", fourth).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(-(-len(r["text"].encode()) // 4) for r in fourth.collect())
    whole = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).drop("shard", "window_no", "step", "offset", "tier").collect()]
    assert sorted(whole, key=repr) == sorted(((r["doc_id"], r["piece"], r["start"], r["n_tokens"]) for r in packed), key=repr)


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
