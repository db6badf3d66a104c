"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy, by backpropagation through time, on a bounded sample of documents
whose language is given. It labels every byte of a text; the probabilities of all positions are
pooled to those of the document. A document whose best pooled probability is below ``ACCEPT`` has no
language that the network knows, and is rejected.

Defined results
* a null or empty text has no position, and is rejected.
* texts are read whole, in windows of ``CORE`` bytes with ``CONTEXT`` bytes on either side.
* of languages with equal probability the first by name wins; repeated rows get equal results.
* rows whose language is null teach nothing; where no row has one, every document is rejected.
* an empty table stays empty; further columns are ignored, or carried along by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import chunks, only, raw_bytes
from siltstone.llm.recurrent import Bidirectional, Gru, Windows, softmax

#: Labelled documents that the network is fitted to, at most, and steps of training.
SAMPLE, STEPS = 1500, 350
HIDDEN, EMBEDDED = 8, 6
CORE, CONTEXT, BATCH = 384, 16, 1024
ACCEPT = 0.4
PAD = 256
SCHEMA = "doc_id bigint, language string, confidence double, n_positions bigint, agreeing bigint"


class Identifier:
    """A trained network and the names of its languages."""

    def __init__(self, languages: list[str], network: Bidirectional | None):
        self.languages, self.network = languages, network

    def pooled(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sums over its positions: of probabilities, and of the labels given; (n, languages)."""
        total = np.zeros((len(raw), len(self.languages)))
        votes = np.zeros((len(raw), len(self.languages)), dtype=np.int64)
        if self.network is None:
            return total, votes
        for begin, end in chunks([len(r) for r in raw], 1 << 21):
            part = raw[begin:end]
            symbols = np.frombuffer(b"".join(part), dtype=np.uint8)
            windows = Windows(np.array([len(r) for r in part], dtype=np.int64), CORE, CONTEXT)
            for own, ids in windows.batches(symbols, PAD, BATCH):
                p = softmax(self.network.scores(ids), axis=1)
                place = np.arange(len(ids))[:, None]
                inside = (place >= windows.left[own]) & (place < windows.left[own] + windows.size[own])
                p *= inside[:, None, :]
                best = p.max(axis=1, keepdims=True)
                label = (p == best) & (best > 0)
                np.add.at(total, begin + windows.sequence[own], p.sum(axis=0, dtype=np.float64).T)
                np.add.at(votes, begin + windows.sequence[own], label.sum(axis=0).T)
        return total, votes

    def identify(self, texts: list[str | None]) -> list[tuple[str | None, float, int, int]]:
        """(language, confidence, positions, positions with that label) of each text."""
        raw = [raw_bytes(t) for t in texts]
        if not self.languages:
            return [(None, 0.0, len(r), 0) for r in raw]
        total, votes = self.pooled(raw)
        best = total.argmax(axis=1)
        return [
            (self.languages[b], round(float(total[i, b] / len(r)), 6), len(r), int(votes[i, b])) if r else (None, 0.0, 0, 0)
            for i, (r, b) in enumerate(zip(raw, best.tolist(), strict=True))
        ]


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 3) -> Identifier:
    """An identifier fitted to (text, language) rows."""
    rows = [(raw_bytes(t), g) for t, g in rows if t and g is not None]
    languages = sorted({g for _, g in rows})
    if not languages:
        return Identifier([], None)
    rng = np.random.default_rng(seed)
    network = Bidirectional(Gru, 257, len(languages), HIDDEN, EMBEDDED, seed)
    by = [[r for r, g in rows if g == name] for name in languages]
    T, B = 80, 96
    for step in range(steps):
        kinds = rng.integers(0, len(languages), B)
        ids = np.full((T, B), PAD, dtype=np.intp)
        for b, k in enumerate(kinds.tolist()):
            text = by[k][rng.integers(0, len(by[k]))]
            at = int(rng.integers(0, max(1, len(text) - T // 2)))
            cut = np.frombuffer(text[at : at + (T if b % 4 else int(rng.integers(4, T)))], dtype=np.uint8)
            ids[: len(cut), b] = cut
        real = ids != PAD
        weight = 1.0 / real.sum()

        def loss(out: np.ndarray, kinds=kinds, real=real, weight=weight):
            p = softmax(out, axis=1)
            value = -float((np.log(np.take_along_axis(p, np.broadcast_to(kinds[None, None, :], (len(p), 1, len(kinds))), axis=1) + 1e-9)[:, 0] * real).sum() * weight)
            p[:, kinds, np.arange(len(kinds))] -= 1
            return value, p * (real[:, None, :] * weight), []

        network.train(ids, loss, 0.02 * (1 - step / steps) + 0.001)
    return Identifier(languages, network.frozen())


def trained(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Identifier:
    """An identifier fitted to at most ``sample`` of the documents whose ``lang`` is given."""
    known = only(docs, "text", "lang").filter("text is not null and text <> '' and lang is not null")
    n = known.count()
    rows = known.sample(fraction=min(1.0, 1.3 * sample / max(n, 1)), seed=5).limit(sample).collect()
    return fit(sorted((r[0], r[1]) for r in rows), steps)


def identified(docs: DataFrame, identifier: Identifier | None = None) -> DataFrame:
    """(doc_id, language, confidence, n_positions, agreeing) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(identifier or trained(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.identify(batch.column(1).to_pylist())
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))],
                names=["doc_id", "language", "confidence", "n_positions", "agreeing"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, identifier: Identifier | None = None, least: float = ACCEPT) -> DataFrame:
    """What ``identified`` has of the documents that are accepted."""
    return identified(docs, identifier).filter(F.col("confidence") >= least)


def stage(docs: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that are accepted, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(trained(docs))

    @F.pandas_udf("double")
    def confidence(texts: pd.Series) -> pd.Series:
        return pd.Series([c for _, c, _, _ in held.value.identify(list(texts))], dtype="float64")

    return docs.filter(confidence(docs["text"]) >= least)
