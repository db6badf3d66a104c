"""Keyset paging of ranked queries: tokens that hold the last score and key, bound to their query."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import invalid
from siltstone.plans.ir import Find
from siltstone.plans.predicates import canonical

HEAD = struct.Struct(">BQd8s")


def fingerprint(q: Find) -> bytes:
    own = asdict(replace(q, limit=None, offset=None, vector_ann=None, timeout_ms=None))
    return hashlib.blake2b(canonical(own).encode(), digest_size=8).digest()


def encode(q: Find, rank: int, score: float, key: str) -> str:
    return (HEAD.pack(1, rank, score, fingerprint(q)) + key.encode()).hex()


def decode(q: Find, token: str) -> tuple[int, float, str]:
    """(rank, score, key) of a token that was made for this query."""
    try:
        raw = bytes.fromhex(token)
        version, rank, score, own = HEAD.unpack(raw[: HEAD.size])
        key = raw[HEAD.size :].decode()
    except (ValueError, struct.error) as e:
        raise invalid("not a cursor") from e
    if version != 1 or own != fingerprint(q):
        raise invalid("the cursor belongs to another query")
    return rank, score, key


def after(df: DataFrame, key: str, score: float, last: str) -> DataFrame:
    """Rows strictly behind (score, key) in the order of the ranking."""
    own, last_key = F.round("score", 9), F.lit(last).cast(dict(df.dtypes)[key])
    return df.filter((own < F.lit(score)) | ((own == F.lit(score)) & (F.col(key) > last_key)))
