"""Snippets: fragments of a text around the terms of a query, for the rows of a final page only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as T

FRAGMENTS, CHARS = (3, 10), (200, 1000)
TYPE = "array<struct<text:string,ranges:array<struct<start:int,end:int>>>>"


def fragments(text: str, terms: set[str], analyzer: str, most: int, chars: int) -> list[dict]:
    """Fragments of up to ``chars`` characters that start at a match; the whole text where it is short enough."""
    hits = [(s, e) for t, s, e in T.offsets(text, analyzer) if t in terms]
    if not hits:
        return []
    raw = text.encode()
    if len(text) <= chars:
        return [{"text": text, "ranges": [{"start": s, "end": e} for s, e in hits]}]
    found, reached = [], 0
    for begin, _ in hits:
        if begin < reached or len(found) == most:
            continue
        piece = raw[begin:].decode()[:chars]
        reached = begin + len(piece.encode())
        found.append({"text": piece, "ranges": [{"start": s - begin, "end": e - begin} for s, e in hits if s >= begin and e <= reached]})
    return found


def snippet(column: Column, query: str, analyzer: str = "default", most: int | None = None, chars: int | None = None) -> Column:
    most = max(1, min(FRAGMENTS[1], FRAGMENTS[0] if most is None else most))
    chars = max(1, min(CHARS[1], CHARS[0] if chars is None else chars))
    terms = {t for t, _, _ in T.offsets(query, analyzer)}

    @F.pandas_udf(TYPE)
    def build(texts: pd.Series) -> pd.Series:
        return pd.Series([fragments(t or "", terms, analyzer, most, chars) for t in texts])

    return build(column)
