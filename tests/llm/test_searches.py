"""Line dedup, near-dedup, decontamination and the two passage searches against plain versions."""

from __future__ import annotations

import random

import brute
import pytest

from siltstone.llm import decontam, lempel_ziv_dedup, line_dedup, runlength_dedup, simhash_dedup

EXTRA = "doc_id bigint, text string, fp string, bucket string, anchor int, gone int, k_doc int, n_removed int, entries int, row int, copy_id int, leaked_id int"


def widened(spark, rows):
    """The rows with further columns that are called like those used inside."""
    return spark.createDataFrame([(d, t, *["x"] * 2, *[7] * 8) for d, t in rows], EXTRA)


# --------------------------------------------------------------------------- lines


def line_rows():
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randrange(0, 12)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "x\ny\nz\nx\ny\nz"), (104, "x\ny\nz"), (105, "\n\n\n\n\n"), (None, "x\ny\nz")]
    rows.append((106, "\n".join(f"line {i % 700}" for i in range(5000))))
    return rows


def test_lines_are_those_of_the_plain_version(spark):
    rows = line_rows()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.line_dedup(rows), key=repr)


def test_a_window_in_every_document_and_a_text_of_many_repeats(spark):
    import time

    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat(id, '\na\nb\nc\n', id * 3) AS text")
    out = line_dedup.dedup_lines(docs)
    assert sorted(r["doc_id"] for r in out.filter("n_removed = 0").collect()) == [0] and out.filter("n_removed = 3").count() == 19_999
    long = spark.createDataFrame([(1, "\n".join(f"l{k % 1000}" for k in range(60_000)))], brute.SCHEMA)
    began = time.monotonic()
    assert [r["n_removed"] for r in line_dedup.dedup_lines(long).collect()] == [59_000]
    assert time.monotonic() - began < 30


def test_repeated_rows_are_one_document_and_other_columns_stay(spark):
    out = line_dedup.dedup_lines(widened(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")]))
    assert out.columns == [*EXTRA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", "), "n_removed_"]
    assert sorted((r["doc_id"], r["text"], r["n_removed_"]) for r in out.collect()) == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "d", 3)]


def test_stage_drops_what_is_left_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "")], brute.SCHEMA)
    assert sorted(r[0] for r in line_dedup.stage(docs).collect()) == [1, 3]


# --------------------------------------------------------------------------- near duplicates


def near_rows():
    rng = random.Random(8)
    rows = []
    for k in range(120):
        words = brute.prose(k, rng.randrange(60, 200))
        rows.append((10 * k, " ".join(words)))
        for c in range(rng.randrange(0, 3)):
            near = list(words)
            for _ in range(rng.randrange(0, 3)):
                near[rng.randrange(len(near))] = "changed"
            rows.append((10 * k + c + 1, " ".join(near)))
    rows += [(5000, None), (5001, ""), (5002, "..."), (5003, "word"), (5004, "Word!"), (None, rows[0][1])]
    rows += [(6000 + k, "the very same text each time " * 30) for k in range(300)]
    rows += [(7000, " ".join(brute.prose(99, 30000))), (7001, " ".join([*brute.prose(99, 30000), "end"]))]
    return rows


def test_groups_are_those_of_all_pairs(spark):
    rows = near_rows()
    want = brute.near_groups(rows)
    got = {r[0]: r[1] for r in simhash_dedup.groups(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert set(got) <= set(want)
    assert sum(got.get(d) == g for d, g in want.items()) >= 0.9 * len(want)
    assert all(got.get(d) == 6000 for d in range(6000, 6300)) and got[5003] == got[5004] == 5003 and got[7001] == 7000


def test_recursion_finds_what_brute_force_finds(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (1500, 4), dtype=np.uint64)
    near = base[:400].copy()
    for row in near:
        for bit in rng.permutation(256)[: rng.integers(0, simhash_dedup.DISTANCE + 1)]:
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    label = simhash_dedup.search(np.concatenate([base, near]), leaf=128)
    assert (label[1500:] == np.arange(400)).mean() >= 0.9
    assert (label[:1500] == np.arange(1500)).all()


def test_one_of_each_group_stays(spark):
    text = " ".join(brute.prose(3, 80))
    rows = [(4, text), (2, text), (9, text), (5, "something else than that"), (6, None), (None, text)]
    out = simhash_dedup.stage(widened(spark, rows))
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([2, 5, 6], key=repr)
    assert len(out.columns) == len(EXTRA.split(","))


def test_of_equal_rows_one_stays(spark):
    text, other = " ".join(brute.prose(3, 80)), " ".join(brute.prose(4, 80))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, other), (None, other), (3, None), (3, None), (4, ""), (5, "one"), (5, "two words")]
    out = simhash_dedup.stage(widened(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, text), (None, other), (3, None), (3, None), (4, ""), (5, "one"), (5, "two words")], key=repr)
    assert out.columns == widened(spark, rows).columns


@pytest.mark.parametrize("longest", [simhash_dedup.LONGEST, 0])
def test_recall_at_the_distance_is_that_aimed_at(spark, longest):
    """Pairs exactly ``DISTANCE`` apart among other fingerprints; with lists filtered twice as well."""
    import numpy as np

    rng = np.random.default_rng(11)
    n = 600 if longest else 60
    base = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 4), dtype=np.uint64)
    near = base.copy()
    for row in near:
        for bit in rng.permutation(256)[: simhash_dedup.DISTANCE]:
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    marks = spark.createDataFrame([tuple(int(x) for x in row.view(np.int64)) for row in np.concatenate([base, near])], "a bigint, b bigint, c bigint, d bigint")
    points, links = simhash_dedup.linked(marks, longest=longest)
    name = {r["id"]: tuple(r[c] for c in "abcd") for r in points.collect()}
    got = {frozenset((name[r["a"]], name[r["b"]])) for r in links.collect()}
    want = [frozenset((tuple(x.view(np.int64).tolist()), tuple(y.view(np.int64).tolist()))) for x, y in zip(base, near, strict=True)]
    assert sum(w in got for w in want) >= (simhash_dedup.RECALL - 0.04) * n and len(got) <= n


def test_long_lists_keep_the_recall():
    """A list beyond ``LEAF``, by the recursion alone."""
    import numpy as np

    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, (5000, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (5000, 4), dtype=np.uint64)
    near = base[:800].copy()
    for row in near:
        for bit in rng.permutation(256)[: simhash_dedup.DISTANCE]:
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    label = simhash_dedup.search(np.concatenate([base, near]))
    assert (label[5000:] == np.arange(800)).mean() >= 1 - (1 - simhash_dedup.RECALL) / 2 - 0.015 and (label[:5000] == np.arange(5000)).all()


def test_work_grows_little_faster_than_the_rows(monkeypatch):
    """Lists stay short at the sizes of 0.5, 6 and 30 GB, and one just beyond ``LEAF`` isn't parted into thousands."""
    import numpy as np

    for n in (236_000, 2_833_000, 13_900_000):
        assert n / 2 ** simhash_dedup.strip_length(n, simhash_dedup.LIST, simhash_dedup.STRIP) <= simhash_dedup.LIST
    calls, plain = [], simhash_dedup.components
    monkeypatch.setattr(simhash_dedup, "components", lambda fps, *rest: calls.append(len(fps)) or plain(fps, *rest))
    n = simhash_dedup.LEAF + 250
    simhash_dedup.search(np.random.default_rng(13).integers(0, 1 << 63, (n, 4), dtype=np.uint64))
    assert 0 < len(calls) < 500 and sum(k * k for k in calls) < 2 * n * n


def test_brute_force_looks_at_few_pairs_twice(monkeypatch):
    """It links the pairs within ``DISTANCE``, and of unrelated ones hardly any gets beyond the first comparison."""
    import numpy as np

    rng = np.random.default_rng(15)
    fps = rng.integers(0, 1 << 63, (1500, 4), dtype=np.uint64)
    for k in range(300):  # the first half differs by DISTANCE bits, the other by one more
        fps[k + 600] = fps[k]
        for bit in rng.permutation(256)[: simhash_dedup.DISTANCE + (k >= 150)]:
            fps[k + 600, bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    seen, plain = [], np.divmod
    monkeypatch.setattr(np, "divmod", lambda a, b: seen.append(len(a)) or plain(a, b))
    label = simhash_dedup.components(fps, simhash_dedup.DISTANCE, np.arange(1500))
    monkeypatch.undo()
    want = np.arange(1500)
    want[600:750] = np.arange(150)
    assert (label == want).all() and sum(seen) < 2 * (1500 + 300)


@pytest.mark.parametrize("n", [236_000, 2_833_000, 13_900_000])
def test_strips_of_every_size_keep_the_recall(n):
    """Pairs exactly ``DISTANCE`` apart meet on a strip of the shuffle, at the lengths of 0.5, 6 and 30 GB."""
    import numpy as np

    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 63, (3000, 4), dtype=np.uint64)
    near = base.copy()
    for row in near:
        for bit in rng.permutation(256)[: simhash_dedup.DISTANCE]:
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    length, recall = simhash_dedup.strip_length(n, simhash_dedup.LIST, simhash_dedup.STRIP), 1 - (1 - simhash_dedup.RECALL) / 2
    met = np.zeros(3000, dtype=bool)
    for k in range(simhash_dedup.repetitions(length, recall)):
        strip = simhash_dedup.strip_of(length, 0, k)
        met |= simhash_dedup.strip_values(base, strip) == simhash_dedup.strip_values(near, strip)
    assert met.mean() >= recall - 0.01


def test_one_text_in_a_third_of_all_rows(spark):
    text = " ".join(brute.prose(3, 40))
    docs = spark.range(9000).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 1 THEN '{text}' ELSE concat('row ', id, ' has ', id * 31, ' other ', id * 77, ' words') END AS text")
    kept = simhash_dedup.stage(docs)
    assert kept.filter(kept["text"] == text).count() == 1


# --------------------------------------------------------------------------- decontamination


def leak_tables():
    rng = random.Random(3)
    items = [(k, " ".join(brute.prose(1000 + k, rng.randrange(3, 40), 400))) for k in range(30)]
    items += [(30, None), (31, ""), (None, items[4][1]), items[5], items[5], (32, "short one"), (33, "a")]
    docs = []
    for k in range(80):
        words = brute.prose(k, rng.randrange(0, 150), 400)
        if k % 2:
            passage = (items[rng.randrange(30)][1]).split()
            for _ in range(rng.randrange(0, 5)):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in passage]
        docs.append((k, " ".join(words)))
    return [*docs, (90, None), (91, ""), (None, items[7][1]), docs[1], docs[1], (92, "Short, one!"), (93, "a short one"), (94, "a")], items


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_leaks_are_those_of_the_plain_version(spark, limit):
    docs, items = leak_tables()
    want = brute.leaks(docs, items)
    times = {d: sum(x == d for x, _ in docs) for d, _ in docs}
    got = decontam.contaminated(spark.createDataFrame(docs, brute.SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), limit).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r for (d, i), n in want.items() for r in [(d, i, n)] * times[d]), key=repr)
    assert len(want) > 20


def test_every_choice_of_two_substitutions_is_found():
    words = brute.prose(1, decontam.WINDOW)
    probe = decontam.Probe([1], [" ".join(words)])
    for a in range(decontam.WINDOW):
        for b in range(a):
            changed = list(words)
            changed[a] = changed[b] = "zz"
            text = decontam.words_of([decontam.normal("before " + " ".join(changed) + " after")])
            assert [x[:2] for x in probe.hits(text)] == [(0, 0)]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_stage_keeps_the_clean_with_or_without_an_id(spark, limit):
    docs, items = leak_tables()
    bad = {d for d, _ in brute.leaks(docs, items)}
    out = decontam.stage(widened(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), limit)
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((d for d, _ in docs if d not in bad), key=repr)
    assert out.columns == widened(spark, docs).columns and None in bad


# --------------------------------------------------------------------------- repeated passages


def passage_rows():
    rng = random.Random(2)
    shared = [brute.prose(500 + k, rng.randrange(40, 160)) for k in range(12)]
    rows = []
    for k in range(70):
        words = brute.prose(k, rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 20)
            words += s[a : rng.randrange(a, len(s) + 1)] + brute.prose(rng.randrange(9999), rng.randrange(0, 9))
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(words)))
    loop = "again and again and " * 60
    rows += [(200, None), (201, ""), (202, loop), (203, loop), (204, "only here " * 90), (None, rows[3][1]), rows[3], rows[3]]
    rows += [(300, " ".join(brute.prose(77, 40000))), (301, " ".join(brute.prose(77, 40000)[20000:20100]))]
    rows += [(400 + k, " ".join(shared[0])) for k in range(150)]
    return rows


@pytest.mark.parametrize("search", [runlength_dedup, lempel_ziv_dedup])
def test_passages_are_those_of_the_plain_version(spark, search):
    rows = passage_rows()
    got = search.duplicates(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    want = brute.passages(rows, 50)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


@pytest.mark.parametrize("search", [runlength_dedup, lempel_ziv_dedup])
def test_other_columns_are_ignored(spark, search):
    text = " ".join(brute.prose(1, 55))
    got = search.duplicates(widened(spark, [(1, text), (2, "x " + text)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 55, 55), (2, 1, 56, 55)]


# --------------------------------------------------------------------------- empty tables


def test_empty_tables_give_empty_results(spark):
    none, items = spark.createDataFrame([], brute.SCHEMA), spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], brute.SCHEMA)
    for df in (
        line_dedup.dedup_lines(none), simhash_dedup.groups(none), simhash_dedup.stage(none), runlength_dedup.duplicates(none),
        lempel_ziv_dedup.duplicates(none), decontam.contaminated(none, items), decontam.contaminated(some, items.limit(0)), decontam.stage(none, items),
    ):
        assert df.collect() == []
