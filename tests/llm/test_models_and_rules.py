"""Packing, quality rules, URL rules, and the two trained networks: invariants, plain versions and held-out accuracy."""

from __future__ import annotations

import itertools
import random
import re
from statistics import NormalDist

import numpy as np
import pytest

from siltstone.llm import language_id, packing, pii, quality_rules, url_rules

SCHEMA = "doc_id bigint, text string"

# --------------------------------------------------------------------------- packing


def test_every_token_is_packed_once_and_no_window_overflows(spark):
    rng = random.Random(1)
    rows = [(k, "x" * int(4 * rng.lognormvariate(5, 1.6))) for k in range(900)]
    rows += [(None, "ab"), (None, "ab"), (5, "same id"), (2000, None), (2001, ""), (2002, "long " * 40000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA + ", n int, shard int")
    out = [r.asDict() for r in packing.packed(docs, shard=300).collect()]
    want = sorted(-(-len(t) // 4) for _, t in rows if t)
    assert sum(r["n_tokens"] for r in out) == sum(want)
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
    for d, t in rows:
        if t and d not in (None, 5):
            at = 0
            for start, n in sorted(by_doc[d]):
                assert start == at
                at += n
            assert at == -(-len(t) // 4)
    windows: dict = {}
    for r in out:
        windows.setdefault((r["shard"], r["tier"], r["window_no"], r["step"]), []).append((r["offset"], r["n_tokens"]))
    assert len({k[:3] for k in windows}) == len(windows)
    for (_, tier, _, _), pieces in windows.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= tier
    assert not {2000, 2001} & set(by_doc)


def test_shards_are_even_whatever_the_ids(spark):
    docs = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "repeat('word ', 20) AS text")
    sizes = [r["count"] for r in packing.packed(docs, shard=500).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) - min(sizes) <= 8
    assert packing.packed(docs.limit(0)).collect() == []


def test_pieces_go_to_the_shortest_tier_and_gaps_are_filled():
    rows = packing.pack([(1, 10), (2, 7), (3, 4), (4, 3), (5, 2)], (4, 8, 16), 32)
    # the window of 16 has room for 6: the longest piece that fits is 4, then 2; that of 8 has room for 1
    assert [(r[0], r[1], r[3], r[4], r[7]) for r in rows] == [(16, 0, 0, 1, 10), (16, 0, 10, 3, 4), (16, 0, 14, 5, 2), (8, 0, 0, 2, 7), (4, 0, 0, 4, 3)]
    assert packing.pack([]) == []


def test_steps_are_balanced():
    rng = random.Random(7)
    rows = packing.pack([(k, rng.randrange(1, 3000)) for k in range(4000)])
    for tier in packing.TIERS:
        steps: dict[int, int] = {}
        for r in rows:
            if r[0] == tier:
                steps[r[2]] = steps.get(r[2], 0) + r[7]
        if len(steps) > 1:
            assert max(steps.values()) - min(steps.values()) <= 2 * tier


# --------------------------------------------------------------------------- quality rules

GOOD = "This is quite an ordinary sentence, with words of usual length and nothing else to be said about it."
BAD = {
    "no_words": " \n\t ", "few_letters": "1234 5678 90 a", "symbols": "some words ### $$$ &&& *** ||| here", "exclamations": "buy now! cheap! best!",
    "upper_case": "ALL OF THIS IS SHOUTED AT YOU", "word_length": "a" * 400, "repetition": "spam " * 50,
}


def test_each_rule_rejects_its_kind_and_keeps_prose(spark):
    rows = [(k, BAD[name]) for k, name in enumerate(BAD)] + [(50, GOOD), (50, GOOD), (None, GOOD), (60, None), (61, ""), (62, GOOD * 5000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA + ", n string")
    for k, name in enumerate(BAD):
        hit = [r["doc_id"] for r in docs.selectExpr("doc_id", f"{quality_rules.rule(name)} AS hit").collect() if r["hit"]]
        assert k in hit and 50 not in hit and 62 not in hit and 60 in hit
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([50, 50, None, 62], key=repr)


def test_the_order_changes_cost_but_not_the_result(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*BAD.values(), GOOD] * 4)], SCHEMA)
    order = quality_rules.order_rules(docs)
    assert {r[0] for r in order} == set(quality_rules.RULES)
    left, rates = docs.count(), []
    for _, seconds, share in order:  # what is rejected per second never grows
        rates.append(round(share * left) / seconds)
        left -= round(share * left)
    assert all(a >= b or b == 0 for a, b in itertools.pairwise(rates)) and all(r[1] > 0 for r in order)
    ways = [[r[0] for r in order], list(quality_rules.RULES), list(reversed(quality_rules.RULES))]
    assert len({tuple(sorted(r[0] for r in quality_rules.apply_rules(docs, way).collect())) for way in ways}) == 1
    assert quality_rules.apply_rules(docs.limit(0)).collect() == []


def test_the_cascade_goes_by_what_the_rules_before_leave():
    judged = [{"a": k < 6, "b": k < 5, "c": k in (6, 7), "d": False} for k in range(10)]
    # b rejects less per second than a, and after a nothing more; c does
    order = quality_rules.cascade({"a": 1.0, "b": 1.0, "c": 2.0, "d": 0.5}, judged)
    assert [(r[0], r[2]) for r in order] == [("a", 0.6), ("c", 0.5), ("d", 0.0), ("b", 0.0)]
    assert [r[0] for r in quality_rules.cascade({"a": 2.0, "b": 1.0}, [])] == ["b", "a"]


@pytest.mark.parametrize(
    ("name", "met", "beyond"),
    [("exclamations", "word word word !", "word word !"), ("symbols", "#" * 7 + "a" * 93, "#" * 8 + "a" * 92), ("few_letters", "1234567abc", "12345678ab"), ("repetition", "same same other words here", "same same other words"), ("word_length", "a" * 25, "a" * 26)],
)
def test_thresholds_met_exactly_keep_a_text(spark, name, met, beyond):
    hits = spark.createDataFrame([(0, met), (1, beyond)], "k int, text string").selectExpr("k", quality_rules.rule(name)).orderBy("k").collect()
    assert [r[1] for r in hits] == [False, True]


# --------------------------------------------------------------------------- URL rules


def url_rows():
    rng = random.Random(6)
    rows = []
    for k in range(300):
        host, path, q = rng.choice(["a.com", "b.org", "spam.net"]), rng.choice(["news", "win", f"item/{k}"]), rng.choice(["", "?ref=x", "?id=1"])
        bad = (host == "spam.net" and path == "win") or (q == "?ref=x" and rng.random() < 0.6)
        rows.append((f"http{'s' * (k % 2)}://www.{host}/{path}{q}", bad))
    return rows


def plain_rules(sets, support, alpha):
    n, bad = len(sets), sum(b for _, b in sets)
    every: dict[frozenset, list[int]] = {}
    for items, b in sets:
        for k in range(1, url_rules.WIDTH + 1):
            for c in itertools.combinations(sorted(items), k):
                x = every.setdefault(frozenset(c), [0, 0])
                x[0] += 1
                x[1] += b
    looked = {c: x for c, x in every.items() if x[1] / n >= support}
    z = NormalDist().inv_cdf(1 - alpha / max(len(looked), 1))
    share = bad / n
    good = {c: b / m for c, (m, b) in looked.items() if b / m >= share and (b / m - share) / (share * (1 - share) / m) ** 0.5 > z}
    return {c for c, x in good.items() if not any(o < c and good[o] >= x for o in good)}


def test_rules_are_those_of_the_plain_version(spark):
    rows = url_rows()
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    sets = [(frozenset(r[0]), r[1]) for r in frame.select(url_rules.tokens(frame["url"]), "bad").collect()]
    want_rules = plain_rules(sets, 0.05, 0.05)
    rules = url_rules.mine(frame, 0.05, 0.05)
    assert {frozenset(r["items"]) for r in rules.collect()} == want_rules and frozenset(["h:spam", "p:win"]) in want_rules
    pages = spark.createDataFrame([(k, u, 1, 2, 3) for k, (u, _) in enumerate(rows)] + [(None, rows[0][0], 1, 2, 3), (900, None, 1, 2, 3), (901, "", 1, 2, 3)], "page_id bigint, url string, row int, token int, n int")
    for limit in (url_rules.BROADCAST_ROWS, 0):
        got = {(r["page_id"], r["n_rules"]) for r in url_rules.match(pages, rules, limit).collect()}
        want = {(k, m) for k, (items, _) in enumerate(sets) if (m := sum(c <= items for c in want_rules))}
        assert {x for x in got if x[0] is not None} == want and not {900, 901} & {x[0] for x in got}
        judged = url_rules.judge(pages, rules, limit).collect()
        assert len(judged) == len(rows) + 3 and {(r["page_id"], r["n_rules"]) for r in judged if r["n_rules"]} == got


def test_labels_that_say_nothing_give_no_rules(spark):
    rng = random.Random(2)
    rows = [(f"http://{rng.choice('abcdefgh')}.com/{rng.choice(['x', 'y', 'z'])}?q={rng.randrange(5)}", rng.random() < 0.24) for _ in range(3000)]
    assert url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), 0.001).collect() == []


def test_pages_are_labelled_by_their_documents(spark):
    pages = spark.createDataFrame(
        [(0, "http://a.com/en/5", 1), (1, "http://a.com/en/6.html", 1), (2, "http://a.com/7/?page=2#top", 1), (3, "http://a.com/5", 1), (4, "http://a.com/x", 1), (5, None, 1), (6, "", 1), (7, "http://a.com/99", 1), (5, "http://a.com/8", 1), (9, "http://a.com/5", 1)],
        "page_id bigint, url string, bad int",
    )
    labels = spark.createDataFrame([(5, 0, None, 1), (5, 1, 0, 1), (6, 1, 0, 1), (7, None, None, 1), (8, None, 1, 1), (None, 0, 1, 1)], "doc_id bigint, quality int, toxic int, own int")
    got = sorted((r["url"], r["bad"]) for r in url_rules.labelled_pages(pages, labels).collect())
    assert got == [("http://a.com/5", True), ("http://a.com/5", True), ("http://a.com/8", True), ("http://a.com/en/5", True), ("http://a.com/en/6.html", False)]
    assert url_rules.labelled_pages(pages.limit(0), labels).collect() == [] and url_rules.labelled_pages(pages, labels.limit(0)).collect() == []


def test_nothing_is_learnt_from_nothing(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    rules = url_rules.mine(none)
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert rules.collect() == [] and url_rules.match(pages, rules).collect() == []
    assert url_rules.mine(spark.createDataFrame([("http://a.com/x", True)] * 9, "url string, bad boolean")).collect() == []
    assert url_rules.judge(pages.limit(0), rules).collect() == []


# --------------------------------------------------------------------------- language identification


@pytest.fixture(scope="module")
def identified_rows(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/../sf0.01/documents.parquet").select("text", "lang").collect()]


@pytest.fixture(scope="module")
def identifier(identified_rows):
    return language_id.fit([r for k, r in enumerate(identified_rows) if k % 2], steps=200)


def test_languages_of_held_out_documents(identifier, identified_rows):
    held = [r for k, r in enumerate(identified_rows) if k % 2 == 0 and r[0] and len(r[0]) > 40]
    got = identifier.identify([t for t, _ in held])
    assert np.mean([g[0] == lang for g, (_, lang) in zip(got, held, strict=True)]) >= 0.9


def test_language_of_odd_texts(spark, identifier):
    long = "the house and the garden of the people " * 20000
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, long, 1), (3, long, 1), (None, "some words of text", 1)], SCHEMA + ", language int")
    got = language_id.identified(docs, identifier).collect()
    assert sorted((r["n_positions"] for r in got)) == [0, 0, 18, len(long), len(long)]
    assert {(r["language"], r["confidence"]) for r in got if r["doc_id"] in (1, 2)} == {(None, 0.0)}
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    assert language_id.accepted(docs.limit(0), identifier).collect() == []


def test_of_languages_with_equal_probability_the_first_wins():
    class Flat:
        def scores(self, ids):
            return np.zeros((len(ids), 2, ids.shape[1]), dtype=np.float32)

    assert language_id.Identifier(["de", "en"], Flat()).identify(["abc"]) == [("de", 0.5, 3, 3)]


def test_without_labels_all_are_rejected(spark):
    docs = spark.createDataFrame([(1, "text", None)], SCHEMA + ", lang string")
    assert language_id.stage(docs).collect() == [] and language_id.stage(docs.limit(0)).collect() == []


def test_gradients_by_backpropagation_through_time():
    from siltstone.llm.recurrent import Bidirectional, Gru, Lstm

    for cell in (Gru, Lstm):
        net = Bidirectional(cell, 7, 3, 4, 3, 1)
        ids = np.random.default_rng(2).integers(0, 7, (5, 2))
        held: list = []
        net._adam = lambda grads, rate, held=held: held.append(grads)  # noqa: SLF001

        def loss(out):
            return float((out.astype(np.float64) ** 2).sum() / 2), out, []

        net.train(ids, loss, 0)
        for p, g in zip(net.parameters()[:2], held[0][:2], strict=True):
            for place in [(0, 0), (1, 2), (2, 1)]:
                if p is net.parameters()[1] and not net.cells[0].mask[place]:
                    continue
                old, e = p[place], 1e-2
                p[place] = old + e
                up = loss(net.scores(ids))[0]
                p[place] = old - e
                down = loss(net.scores(ids))[0]
                p[place] = old
                assert abs((up - down) / (2 * e) - g[place]) <= 0.03 * max(1.0, abs(g[place]))


# --------------------------------------------------------------------------- personal data


@pytest.fixture(scope="module")
def finder():
    return pii.fit(["plain words of a text about houses and gardens and the people that live there"] * 3, steps=350)


def test_spans_of_held_out_items(finder):
    rng = np.random.default_rng(123)
    words = "plain words about some gardens and houses of people".split()
    hit = total = 0
    for _ in range(200):
        pieces = pii.item(rng, words)[0]
        before = " ".join(words) + " "
        at = len(before) + sum(len(p) for p, t in itertools.takewhile(lambda x: not x[1], pieces))
        text, tag = next((p, t) for p, t in pieces if t)
        got = finder.spans([before + "".join(p for p, _ in pieces) + " " + " ".join(words)])[0]
        total += 1
        hit += any(s < at + len(text) and e > at and k == tag for s, e, k in got)
    assert hit >= 0.85 * total
    assert sum(map(len, finder.spans([" ".join(words) * 3] * 20))) <= 2


def test_items_of_the_given_documents_are_found(identified_rows):
    """What patterns find in documents that weren't generated here, and how many documents without are marked."""
    kinds = {1: r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+", 2: r"\(\d{3}\) \d{3}-\d{4}", 3: r"\b\d{1,3}(?:\.\d{1,3}){3}\b", 4: r"\b\d{4}(?:[ -]?\d{4}){3}\b", 5: r"\b[0-9a-f]{32,64}\b"}
    texts = [t for t, _ in identified_rows if t]
    plain = sorted(t for t in texts if not re.search("[0-9@]", t))
    found = pii.fit(plain[::2], steps=500).spans(texts)
    for kind, pattern in kinds.items():
        hits = [any(a < m.end() and b > m.start() and k == kind for a, b, k in spans) for t, spans in zip(texts, found, strict=True) for m in re.finditer(pattern, t)]
        assert len(hits) >= 10 and sum(hits) >= 0.9 * len(hits), kind
    clean = [not spans for t, spans in zip(texts, found, strict=True) if not any(re.search(p, t) for p in kinds.values())]
    assert sum(clean) >= 0.98 * len(clean)


def test_windows_agree_with_the_whole(finder, monkeypatch):
    rng = np.random.default_rng(7)
    words = "plain words about some gardens and houses of people".split()
    texts = []
    for _ in range(6):
        pieces = [w for k in range(700) for w in ([*(p for p, _ in pii.item(rng, words)[0]), " "] if k % 60 == 9 else [words[k % len(words)], " "])]
        texts.append("".join(pieces))
    cut = finder.spans(texts)
    monkeypatch.setattr(pii, "CORE", 1 << 20)
    whole = finder.spans(texts)
    joined = {(k, *s) for k, spans in enumerate(cut) for s in spans} ^ {(k, *s) for k, spans in enumerate(whole) for s in spans}
    assert sum(map(len, whole)) >= 50 and len(joined) <= 0.03 * sum(map(len, whole))


def test_the_shortcut_skips_nothing_that_viterbi_tags():
    rng = np.random.default_rng(8)
    for _ in range(60):
        out = rng.normal(size=(6, pii.TAGS, 60)).astype(np.float32)
        out[:, 0] += 2.0
        out[0, 1:] += rng.random() * 3
        moves = rng.normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32) * 2
        network = type("Network", (), {"extra": [moves]})()
        lengths = rng.integers(1, 7, 60)
        open_, tags = pii.Finder(network)._decoded(out, lengths)  # noqa: SLF001
        full = pii.viterbi(out, moves, lengths)
        assert not np.delete(full, open_, axis=1).any() and (full[:, open_] == tags).all()


def test_many_spans_are_reconciled_in_time():
    spans = [(7 * k, 7 * k + 5 + k % 4, 1 + k % 3) for k in range(60_000)]
    kept = pii.reconciled(spans)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(kept)) and len(kept) >= 30_000


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    out, moves = rng.normal(size=(4, 3, 5)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    tags = pii.viterbi(out, moves, np.full(5, 4))
    for b in range(5):
        best = max(itertools.product(range(3), repeat=4), key=lambda p: sum(out[t, p[t], b] for t in range(4)) + sum(moves[p[t], p[t + 1]] for t in range(3)))  # noqa: B023
        assert tuple(tags[:, b].tolist()) == best


def test_spans_are_reconciled():
    assert pii.reconciled([(0, 5, 1), (5, 9, 1), (3, 6, 2), (20, 22, 3)]) == [(0, 9, 1), (20, 22, 3)]
    assert pii.reconciled([(0, 4, 1), (2, 6, 2)]) == [(0, 4, 1)] and pii.reconciled([]) == []


def test_odd_rows_have_no_spans(spark, finder):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "mail bob@mail3.example.org ok", 1)], SCHEMA + ", kind int")
    got = pii.found_items(docs, finder).collect()
    assert got and {r["doc_id"] for r in got} == {None} and all(r["found"] in "mail bob@mail3.example.org ok" for r in got)
    assert pii.found_items(docs.limit(0), finder).collect() == []
    twice = spark.createDataFrame([(1, "write to bob@mail3.example.org ok", 0, 1, "x", "y")] * 2, SCHEMA + ", start int, end int, found string, kind string")
    rows = [tuple(r) for r in pii.found_items(twice, finder).collect()]
    assert rows and rows[: len(rows) // 2] == rows[len(rows) // 2 :] and twice.columns[2] == "start"
