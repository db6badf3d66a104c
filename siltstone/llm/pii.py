"""Personal data and secrets, by a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: pieces of a bounded sample of documents into
which generated items are put, whose places are known. Texts are read in overlapping windows; each is
decoded by Viterbi, and the spans of all windows of a text are reconciled: those of one kind that
overlap or touch are one span, and of overlapping spans of other kinds the longest stays.

Kinds: email, phone, ip, card (payment card numbers) and secret (keys and tokens). Positions count
characters (Unicode code points) from 0.

Defined results
* a null or empty text has no spans; texts are read whole, however long.
* a span may cross any number of windows; equally long spans that overlap: the first by place, then kind, stays.
* repeated rows have equal spans each, and a null doc_id is carried along.
* an empty table gives no rows; further columns are ignored.
* without any text to learn from, the generated items are taught by themselves.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import chunks, only
from siltstone.llm.recurrent import Bidirectional, Lstm, Windows

KINDS = ("email", "phone", "ip", "card", "secret")
TAGS = 1 + len(KINDS)
#: Documents whose text is used in training, at most, and steps of training.
SAMPLE, STEPS = 1000, 900
HIDDEN, EMBEDDED = 10, 8
CORE, CONTEXT, BATCH = 448, 48, 1024
PAD, SYMBOLS = 0, 100
SCHEMA = "doc_id bigint, kind string, start bigint, end bigint, found string"


def _symbol_table() -> np.ndarray:
    """Class of each code point below 0x3000: ASCII by itself, else white space, letter or other."""
    table = np.full(0x3000, 98, dtype=np.uint8)
    for c in range(0x3000):
        if 32 <= c < 127:
            table[c] = c - 31
        elif chr(c).isspace():
            table[c] = 96
        elif chr(c).isalpha():
            table[c] = 97
    return table


TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 0x3000, TABLE[np.minimum(points, 0x2FFF)], 97).astype(np.uint8)


# --------------------------------------------------------------------------- labelled spans


def item(rng: np.random.Generator, words: list[str]) -> tuple[list[tuple[str, int]], None]:
    """Pieces (text, tag) of one generated item with its surroundings."""
    n = lambda a, b: int(rng.integers(a, b))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k).tolist()))
    word = lambda: "".join(c for c in words[n(0, len(words))].lower() if c.isalpha() and c.isascii()) or "mail"
    kind = n(0, len(KINDS))
    if kind == 0:
        local = word() + (("", ".", "_", "-")[n(0, 4)] + (word(), digits(n(1, 4)))[n(0, 2)] if n(0, 4) else "")
        host = (f"mail{n(0, 100)}.example", word(), f"{word()}.{word()}", f"{word()}-{word()}")[n(0, 4)]
        return [(f"{local}@{host}.{('com', 'org', 'net', 'de', 'fr', 'es', 'io')[n(0, 7)]}", 1)], None
    if kind == 1:
        form = n(0, 6)
        a, b, c = digits(3), digits(3) if n(0, 2) else "555", digits(4)
        return [((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{n(1, 99)} {a} {b} {c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}")[form if n(0, 2) else 0], 2)], None
    if kind == 2:
        return [(".".join(str(n(0, 256)) for _ in range(4)), 3)], None
    if kind == 3:
        gap = ("", "", "", "-", " ")[n(0, 5)]
        return [(gap.join(digits(4) for _ in range(4)), 4)], None
    key = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, (32, 40, 40, 40, 64)[n(0, 5)]))
    if n(0, 4) == 0:
        key = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[i] for i in rng.integers(0, 62, n(24, 44)))
    name = ("token", "token", "api_key", "secret", "password", "key")[n(0, 6)]
    lead = (f'{name} = "', f'{name} = "', f"{name}: ", f"{name}=", f'"{name}": "')[n(0, 5)]
    return [(lead, 0), (key, 5), ('"' if lead.endswith('"') else "", 0)], None


def decoy(rng: np.random.Generator, words: list[str]) -> str:
    """What only looks like an item."""
    n = lambda a, b: int(rng.integers(a, b))
    word = lambda: words[n(0, len(words))]
    return (
        lambda: str(n(0, 10 ** n(1, 8))), lambda: f"{n(0, 30)}.{n(0, 30)}", lambda: f"{n(0, 30)}.{n(0, 30)}.{n(0, 30)}", lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}",
        lambda: f"www.{word()}.com", lambda: f'{word()} = "{word()}"', lambda: f"{n(0, 24)}:{n(0, 60):02}", lambda: f"@{word()}", lambda: f"({n(0, 1000)})", lambda: f"{word()}###", lambda: f"{n(1, 100)}%",
        lambda: f"https://{word()}.example.com/{n(0, 999)}", lambda: f"{word()}-{word()}-{word()}", lambda: word().upper() + "!!",
    )[n(0, 14)]()


def generated(rng: np.random.Generator, texts: list[str], length: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tags), each (length, batch): pieces of texts with items and decoys put in at word boundaries."""
    ids, tags = np.full((length, batch), PAD, dtype=np.intp), np.zeros((length, batch), dtype=np.intp)
    for b in range(batch):
        text = texts[rng.integers(0, len(texts))]
        at = int(rng.integers(0, max(1, len(text) - length)))
        words = text[at : at + length].split(" ") or ["a"]
        pieces: list[tuple[str, int]] = []
        begin = rng.integers(0, 16) == 0
        for k, w in enumerate(words):
            gap = ("###", "&&& ", "$$$", ". ", ", ", "\n", '"', ") ", "*** ", "%%%")[rng.integers(0, 10)] if rng.random() < 0.25 else " "
            if rng.random() < 0.07 or (k == 0 and begin):
                pieces += item(rng, words)[0]
                pieces.append((gap, 0))
            elif rng.random() < 0.05:
                pieces.append((decoy(rng, words) + gap, 0))
            pieces.append((w + " ", 0))
        whole = "".join(p for p, _ in pieces)
        mark = np.repeat([t for _, t in pieces], [len(p) for p, _ in pieces])
        skip = int(rng.integers(0, 12))
        whole, mark = whole[skip : skip + length], mark[skip : skip + length]
        ids[: len(whole), b] = symbols(whole)
        tags[: len(whole), b] = mark
    return ids, tags


# --------------------------------------------------------------------------- the CRF


def crf_loss(out: np.ndarray, tags: np.ndarray, real: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Negative log likelihood of tag sequences, its gradients by outputs (T, K, B) and by ``moves`` (K, K); forward-backward, scaled."""
    T, K, B = out.shape
    top = out.max(axis=1, keepdims=True)
    e = np.exp(out - top)
    A = np.exp(moves).astype(np.float32)
    alpha, norm = np.empty_like(e), np.empty((T, B), dtype=np.float32)
    for t in range(T):
        a = e[t] * (A.T @ alpha[t - 1] if t else 1)
        if t:
            a = np.where(real[t], a, alpha[t - 1])
        norm[t] = a.sum(axis=0)
        alpha[t] = a / norm[t]
    beta = np.ones((K, B), dtype=np.float32)
    gamma, dmoves = np.empty_like(e), np.zeros((K, K), dtype=np.float32)
    for t in range(T - 1, -1, -1):
        g = alpha[t] * beta
        gamma[t] = g / g.sum(axis=0)
        if t:
            eb = np.where(real[t], e[t] * beta / norm[t], 0)
            dmoves += (alpha[t - 1] @ eb.T) * A
            beta = np.where(real[t], A @ eb, beta)
    value = float((np.log(norm) * real).sum() + (top[:, 0] * real).sum())
    picked = np.take_along_axis(out, tags[:, None, :], axis=1)[:, 0]
    value -= float((picked * real).sum())
    both = real[1:] & real[:-1]
    value -= float((moves[tags[:-1], tags[1:]] * both).sum())
    np.subtract.at(dmoves, (tags[:-1][both], tags[1:][both]), 1)
    weight = 1.0 / max(1, real.sum())
    one = np.zeros_like(gamma)
    np.put_along_axis(one, tags[:, None, :], 1, axis=1)
    return value * weight, (gamma - one) * (real[:, None, :] * np.float32(weight)), [dmoves * np.float32(weight)]


def viterbi(out: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags (T, B) of outputs (T, K, B)."""
    T, K, B = out.shape
    back = np.zeros((T, K, B), dtype=np.int8)
    score = out[0].copy()
    scores = [score]
    for t in range(1, T):
        ways = score[:, None, :] + moves[:, :, None]
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + out[t]
        scores.append(score)
    tags = np.zeros((T, B), dtype=np.int8)
    last = lengths - 1
    held = np.stack(scores)[last, :, np.arange(B)].argmax(axis=1)
    for t in range(T - 1, -1, -1):
        inside = t <= last
        tags[t] = np.where(inside, held, 0)
        if t:
            held = np.where(inside, back[t, held, np.arange(B)], held)
    return tags


class Finder:
    """A trained network with its transitions."""

    def __init__(self, network: Bidirectional):
        self.network = network

    @property
    def moves(self) -> np.ndarray:
        return self.network.extra[0]

    def _decoded(self, out: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, tags) of those whose best path isn't provably free of items.

        What a path gains by tagging some positions is bounded by taking, at each, the best tag and
        the best of the transitions into, within and out of items; where the best stretch of any
        window gains nothing, tagging none is best. A path pays nothing to begin with an item, or to
        end with one.
        """
        moves = self.moves - self.moves[0, 0]
        enter, stay, leave = float(moves[0, 1:].max()), float(moves[1:, 1:].max()), max(0.0, float(moves[1:, 0].max()))
        lead = out[:, 1:].max(axis=1) - out[:, 0]
        best = np.full(out.shape[2], -np.inf, dtype=np.float32)
        gains = np.zeros(out.shape[2], dtype=bool)
        for t, gain in enumerate(lead):
            best = np.maximum(best + stay, enter if t else 0.0) + gain
            gains |= (best + leave >= 0) & (t < lengths)
        open_ = np.flatnonzero(gains)
        if not len(open_):
            return open_, np.zeros((len(out), 0), dtype=np.int8)
        return open_, viterbi(np.ascontiguousarray(out[:, :, open_]), self.moves, lengths[open_])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, kind) of each text, in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for begin, end in chunks([4 * len(t) for t in texts], 1 << 23):
            parts = [symbols(t) for t in texts[begin:end]]
            windows = Windows(np.array([len(p) for p in parts], dtype=np.int64), CORE, CONTEXT)
            if not len(windows.sequence):
                continue
            for own, ids in windows.batches(np.concatenate(parts), PAD, BATCH):
                open_, tags = self._decoded(self.network.scores(ids), windows.span[own])
                if not tags.any():
                    continue
                padded = np.zeros((tags.shape[1], tags.shape[0] + 2), dtype=np.int8)
                padded[:, 1:-1] = tags.T
                row, edge = np.nonzero(padded[:, 1:] != padded[:, :-1])
                kind = padded[row, edge + 1]
                starts = np.flatnonzero(kind > 0)
                for i in starts.tolist():
                    w = own[open_[row[i]]]
                    s, e = int(edge[i]), int(edge[i + 1])
                    left, size = int(windows.left[w]), int(windows.size[w])
                    if s < left + size and e > left:  # in part at least in the window's own core
                        at = int(windows.begin[w]) - left
                        found[begin + int(windows.sequence[w])].append((at + s, at + e, int(kind[i])))
        return [reconciled(f) for f in found]


def reconciled(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of one kind that overlap or touch joined; of overlapping ones of other kinds the longest."""
    joined: list[list[int]] = []
    for s, e, k in sorted(spans, key=lambda x: (x[2], x[0], x[1])):
        if joined and joined[-1][2] == k and s <= joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([s, e, k])
    kept: list[tuple[int, int, int]] = []  # in order, none overlaps another: only the neighbours need a look
    for s, e, k in sorted(joined, key=lambda x: (x[0] - x[1], x[0], x[2])):
        at = bisect.bisect(kept, (s, e, k))
        if (not at or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
            kept.insert(at, (s, e, k))
    return kept


def fit(texts: list[str], steps: int = STEPS, seed: int = 9) -> Finder:
    """A finder fitted to generated items within the texts."""
    rng = np.random.default_rng(seed)
    network = Bidirectional(Lstm, SYMBOLS, TAGS, HIDDEN, EMBEDDED, seed)
    network.extra = [np.zeros((TAGS, TAGS), dtype=np.float32)]
    texts = [t for t in texts if t] or ["a few words of text to put them in"]
    T, B = 96, 48
    for step in range(steps):
        ids, tags = generated(rng, texts, T, B)
        real = ids != PAD
        network.train(ids, lambda out, tags=tags, real=real: crf_loss(out, tags, real, network.extra[0]), 0.02 * (1 - step / steps) + 0.0005)
    return Finder(network.frozen())


def trained(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Finder:
    """A finder fitted on the text of at most ``sample`` documents that hold neither digits nor ``@``."""
    plain = only(docs, "text").filter("text is not null and text <> '' and not text rlike '[0-9@]'")
    n = plain.count()
    rows = plain.sample(fraction=min(1.0, 1.3 * sample / max(n, 1)), seed=6).limit(sample).collect()
    return fit(sorted(r[0] for r in rows), steps)


def found_items(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """(doc_id, kind, start, end, found): a row for each span of personal data, with its text."""
    held = docs.sparkSession.sparkContext.broadcast(finder or trained(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[i], KINDS[k - 1], s, e, texts[i][s:e]) for i, spans in enumerate(held.value.spans([t or "" for t in texts])) for s, e, k in spans]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["doc_id", "kind", "start", "end", "found"],
            )

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
