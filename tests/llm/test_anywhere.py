"""Passages that repeat at two places, also of one document, against a plain version."""

from __future__ import annotations

import brute
import pytest
from test_searches import passage_rows

from siltstone.llm import lempel_ziv_dedup, runlength_dedup


def passages_anywhere(rows: list[tuple], least: int) -> set[tuple[int, int, int, int]]:
    """(doc_id, start, end, words) of the unions of windows that two places (doc_id, start) have."""
    places: dict[tuple[str, ...], set[tuple[int, int]]] = {}
    for d, t in rows:
        if d is not None and t is not None:
            words = t.split()
            for i in range(len(words) - least + 1):
                places.setdefault(tuple(words[i : i + least]), set()).add((d, i))
    out: list[list[int]] = []
    for d, i in sorted({p for found in places.values() if len(found) > 1 for p in found}):
        if out and out[-1][0] == d and i <= out[-1][2]:
            out[-1][2] = i + least
        else:
            out.append([d, i, i + least])
    return {(d, a, b, b - a) for d, a, b in out}


@pytest.mark.parametrize("search", [runlength_dedup, lempel_ziv_dedup])
def test_passages_within_a_document_are_found(spark, search):
    twice, apart = brute.prose(800, 70), brute.prose(801, 30000)
    rows = [*passage_rows(), (700, " ".join(twice + brute.prose(802, 20) + twice)), (701, " ".join(apart + brute.prose(803, 9) + apart[100:190]))]
    got = search.duplicates(spark.createDataFrame(rows, brute.SCHEMA), anywhere=True).collect()
    want = passages_anywhere(rows, 50)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {(700, 0, 70, 70), (700, 90, 160, 70), (701, 100, 190, 90)} <= want and any(d == 204 for d, *_ in want)
