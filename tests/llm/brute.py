"""Plain versions of the corpus operators, over lists of rows, for comparison."""

from __future__ import annotations

import itertools
import random

from siltstone.llm import common, decontam, simhash_dedup
from siltstone.llm.common import normal

SCHEMA = "doc_id bigint, text string"


def prose(seed: int, n: int, vocabulary: int = 3000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def line_dedup(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, text, removed) of rows that each have an id of their own."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen: set[tuple[str, ...]] = set()
    out = {}
    for k in order:
        doc, text = rows[k]
        lines = text.split("\n") if text is not None else []
        gone: set[int] = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if not "".join(window).strip(" "):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[k] = (doc, text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return [out[k] for k in range(len(rows))]


def fingerprint(text: bytes) -> int | None:
    """Signs of the summed hashes of distinct word pairs, bit by bit; None without words."""
    words = [int(h) for h in common.words_of([text]).hashes]
    if not words:
        return None
    mask = (1 << 64) - 1

    def mix(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    pairs = {mix((a * 0x9E3779B97F4A7C15 + b) & mask) >> 16 for a, b in itertools.pairwise(words)} or {words[0] >> 16}
    sums = [0] * 256
    for f in pairs:
        for c in range(4):
            h = mix((f + (c + 1) * 0x632BE59BD9B4E019) & mask)
            for bit in range(64):
                sums[64 * c + bit] += 1 if h >> bit & 1 else -1
    toss = [mix((sum(pairs) + c) & mask) >> bit & 1 for c in (5, 6, 7, 8) for bit in range(64)]
    return sum(1 << k for k, x in enumerate(sums) if x > 0 or (x == 0 and toss[k]))


def near_groups(rows: list[tuple[int | None, str | None]]) -> dict[int, int]:
    """doc_id -> smallest doc_id of its group, by comparing all pairs of fingerprints."""
    rows = [(d, normal(t)) for d, t in rows if d is not None and t is not None]
    known: dict[bytes, int | None] = {}
    for _, t in rows:
        if t not in known:
            known[t] = fingerprint(t)
    kept = [k for k in range(len(rows)) if known[rows[k][1]] is not None]
    ids = sorted({rows[k][0] for k in kept})
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(kept, 2):
        if rows[a][0] == rows[b][0] or (known[rows[a][1]] ^ known[rows[b][1]]).bit_count() <= simhash_dedup.DISTANCE:
            x, y = sorted((find(rows[a][0]), find(rows[b][0])))
            root[y] = x
    groups = {d: find(d) for d in ids}
    sizes = {r: list(groups.values()).count(r) for r in set(groups.values())}
    return {d: r for d, r in groups.items() if sizes[r] > 1}


def leaks(docs: list[tuple], items: list[tuple]) -> dict[tuple, int]:
    """(doc_id, item_id) -> words of the item in windows that agree but for the substitutions."""
    out: dict[tuple, int] = {}
    for (doc, text), (item, passage) in itertools.product(docs, set(items)):
        a, b = normal(text).split(), normal(passage).split()
        if not b or (len(b) < decontam.PHRASE and len(a) != len(b)):
            continue
        window = min(decontam.WINDOW, len(b))
        wrong = decontam.SUBSTITUTIONS if len(b) >= decontam.WINDOW else 0
        hit: set[int] = set()
        for i in range(len(b) - window + 1):
            if any(sum(x != y for x, y in zip(a[j : j + window], b[i : i + window], strict=True)) <= wrong for j in range(len(a) - window + 1)):
                hit |= set(range(i, i + window))
        if hit:
            out[doc, item] = max(len(hit), out.get((doc, item), 0))
    return out


def passages(rows: list[tuple], least: int) -> set[tuple[int, int, int, int]]:
    """(doc_id, start, end, words) of the unions of windows that another doc_id has as well."""
    owners: dict[tuple[str, ...], set[int]] = {}
    texts = [(d, t.split()) for d, t in rows if d is not None and t is not None]
    for d, words in texts:
        for i in range(len(words) - least + 1):
            owners.setdefault(tuple(words[i : i + least]), set()).add(d)
    starts: dict[int, set[int]] = {}
    for d, words in texts:
        for i in range(len(words) - least + 1):
            if len(owners[tuple(words[i : i + least])]) > 1:
                starts.setdefault(d, set()).add(i)
    out = set()
    for d, found in starts.items():
        begin = end = None
        for i in sorted(found):
            if end is None or i > end:
                if end is not None:
                    out.add((d, begin, end, end - begin))
                begin = i
            end = i + least
        out.add((d, begin, end, end - begin))
    return out
