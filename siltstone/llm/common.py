"""Helpers shared by the corpus operators: input, lineage cuts and numpy hashing of words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.files import Files, cut, shared_dir

__all__ = ["Words", "chunks", "cut", "fresh", "grams", "loose", "mix", "normal", "only", "powers", "raw_bytes", "remove", "shared_dir", "span_hash", "table", "words_of"]

U64 = np.uint64
#: Bytes that end a word; the same set as ``\s`` in RE2.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever it is kept."""
    Files(spark).remove(folder)


def loose(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the (bigint) columns computed anew, so that Spark doesn't rely on how it is partitioned.

    A join then shuffles this side itself, which is what lets AQE split a hot key of the other side.
    """
    return df.withColumns({c: F.col(c).bitwiseXOR(F.lit(0).cast("bigint")) for c in columns})


def fresh(taken: Sequence[str], base: str) -> str:
    """A column name like ``base`` which none of ``taken`` has, whatever its case."""
    used = {c.lower() for c in taken}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that others can't clash with names used inside."""
    return df.select(*[df[c] for c in columns])


# --------------------------------------------------------------------------- numpy hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base modulo 2**64 and their inverses; grown by doubling and kept."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        both = []
        for base in (_BASE, _BASE_INV):
            p = np.ones(size, dtype=U64)
            done, step = 1, base
            while done < size:
                p[done : 2 * done] = p[:done] * U64(step)
                step = step * step % (1 << 64)
                done *= 2
            both.append(p)
        _POWERS[0] = (both[0], both[1])
    up, down = _POWERS[0]
    return up[:n], down[:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, by differences of one running sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


class Words:
    """The words of several texts: hash of each word, and where each text's words begin."""

    __slots__ = ("hashes", "first")

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hashes, self.first = hashes, first


#: Bytes of text that are hashed at a time: the arrays over bytes are tens of times as large.
PIECE = 1 << 21
_BLANK = re.compile(rb"[\t\n\f\r ]")


def words_of(raw: Sequence[bytes]) -> Words:
    """Words of UTF-8 texts, split at white space. Long texts are hashed piece by piece, cut where words end."""
    hashes, counts = [], np.zeros(len(raw) + 1, dtype=np.int64)
    for begin, end in chunks([len(r) for r in raw], PIECE):
        if end == begin + 1 and len(raw[begin]) > PIECE:
            at, text = 0, raw[begin]
            while at < len(text):
                blank = _BLANK.search(text, at + PIECE)
                stop = blank.start() if blank else len(text)
                own = _hashed([text[at:stop]])
                hashes.append(own.hashes)
                counts[end] += len(own.hashes)
                at = stop
        else:
            own = _hashed(raw[begin:end])
            hashes.append(own.hashes)
            counts[begin + 1 : end + 1] = np.diff(own.first)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, dtype=U64), np.cumsum(counts))


def _hashed(raw: Sequence[bytes]) -> Words:
    joined = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    edge = np.diff(SPACE[joined].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) > len(starts):
        ends = ends[len(ends) - len(starts) :]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    hashes = span_hash(_BYTE[joined], starts, ends) if len(starts) else np.zeros(0, dtype=U64)
    return Words(hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions with fewer than k words left are absent."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    at = np.arange(n)
    return span_hash(hashes, at, at + k)


_PUNCT = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def normal(text: str | None) -> bytes:
    """Lower case, with ASCII punctuation as spaces."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT) if text else b""


def raw_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def chunks(sizes: Sequence[int], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text is a range by itself."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
