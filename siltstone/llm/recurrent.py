"""Small bidirectional recurrent networks in numpy: training by backpropagation through time, and inference.

Arrays are (features, batch), so that each gate is a contiguous block. ``M`` maps the stacked state,
embedded symbol and a constant 1 to all gates of a step at once.

States are bounded by x / sqrt(1 + x^2) in place of tanh, and gates by the sigmoid that is made of it:
their gradients are as simple, and they take a fifth of the time, which was most of a step.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def squash_(x: np.ndarray) -> np.ndarray:
    """In place, from -1 to 1."""
    size = x * x
    size += F32(1)
    np.sqrt(size, out=size)
    x /= size
    return x


def sigmoid_(x: np.ndarray) -> np.ndarray:
    """In place, from 0 to 1."""
    squash_(x)
    x *= F32(0.5)
    x += F32(0.5)
    return x


def slope(y: np.ndarray) -> np.ndarray:
    """Of ``squash_``, by its value."""
    rest = np.maximum(1 - y * y, 0)
    return rest * np.sqrt(rest)


def gate_slope(s: np.ndarray) -> np.ndarray:
    """Of ``sigmoid_``, by its value."""
    rest = np.maximum(s * (1 - s), 0)
    return 4 * rest * np.sqrt(rest)


class Gru:
    """Gates: update z, reset r, candidate from the input, candidate from the state (reset after the product)."""

    carries = 1

    def __init__(self, hidden: int, embedded: int, rng: np.random.Generator):
        self.hidden, self.embedded = hidden, embedded
        self.mask = np.ones((4 * hidden, hidden + embedded + 1), dtype=F32)
        self.mask[2 * hidden : 3 * hidden, :hidden] = 0
        self.mask[3 * hidden :, hidden : hidden + embedded] = 0
        self.M = (rng.normal(size=self.mask.shape) / np.sqrt(hidden + embedded)).astype(F32) * self.mask
        self.M[:, -1] = 0

    def step(self, Z: np.ndarray, A: np.ndarray, state: list[np.ndarray]) -> np.ndarray:
        """Gates into ``A`` and the new state, which is returned, into ``state``; ``Z`` holds state and input."""
        H = self.hidden
        np.matmul(self.M, Z, out=A)
        sigmoid_(A[: 2 * H])
        n = A[2 * H : 3 * H]
        n += A[H : 2 * H] * A[3 * H :]
        squash_(n)
        h = state[0]
        h -= n
        h *= A[:H]
        h += n
        return h

    def back(self, dh: np.ndarray, Z: np.ndarray, A: np.ndarray, kept: list[np.ndarray], carry: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the gates, direct gradient of the state before)."""
        H = self.hidden
        h, z, r, n, m = Z[:H], A[:H], A[H : 2 * H], A[2 * H : 3 * H], A[3 * H :]
        d = np.empty_like(A)
        dn = dh * (1 - z) * slope(n)
        d[:H] = dh * (h - n) * gate_slope(z)
        d[H : 2 * H] = dn * m * gate_slope(r)
        d[2 * H : 3 * H] = dn
        d[3 * H :] = dn * r
        return d, dh * z


class Lstm:
    """Gates: input i, forget f, output o, candidate g; the carry is the cell."""

    carries = 2

    def __init__(self, hidden: int, embedded: int, rng: np.random.Generator):
        self.hidden, self.embedded = hidden, embedded
        self.mask = np.ones((4 * hidden, hidden + embedded + 1), dtype=F32)
        self.M = (rng.normal(size=self.mask.shape) / np.sqrt(hidden + embedded)).astype(F32)
        self.M[:, -1] = 0
        self.M[hidden : 2 * hidden, -1] = 1

    def step(self, Z: np.ndarray, A: np.ndarray, state: list[np.ndarray]) -> np.ndarray:
        H = self.hidden
        np.matmul(self.M, Z, out=A)
        sigmoid_(A[: 3 * H])
        g = squash_(A[3 * H :])
        h, c = state
        c *= A[H : 2 * H]
        c += A[:H] * g
        np.multiply(c, c, out=h)
        h += F32(1)
        np.sqrt(h, out=h)
        np.divide(c, h, out=h)
        h *= A[2 * H : 3 * H]
        return h

    def back(self, dh: np.ndarray, Z: np.ndarray, A: np.ndarray, kept: list[np.ndarray], carry: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        H = self.hidden
        i, f, o, g = A[:H], A[H : 2 * H], A[2 * H : 3 * H], A[3 * H :]
        before, after = kept
        t = squash_(after.copy())
        dc = carry[0] + dh * o * slope(t)
        d = np.empty_like(A)
        d[:H] = dc * g * gate_slope(i)
        d[H : 2 * H] = dc * before * gate_slope(f)
        d[2 * H : 3 * H] = dh * t * gate_slope(o)
        d[3 * H :] = dc * i * slope(g)
        carry[0] = dc * f
        return d, np.zeros_like(dh)


class Bidirectional:
    """Two cells over the symbols, one from each end, and a linear layer over both states."""

    def __init__(self, cell: type, symbols: int, classes: int, hidden: int, embedded: int, seed: int):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(size=(embedded, symbols)).astype(F32)
        self.cells = [cell(hidden, embedded, rng), cell(hidden, embedded, rng)]
        self.out = (rng.normal(size=(classes, 2 * hidden + 1)) / np.sqrt(2 * hidden)).astype(F32)
        self.out[:, -1] = 0
        self.extra: list[np.ndarray] = []
        self._moments: list[np.ndarray] | None = None
        self._steps = 0

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.cells[0].M, self.cells[1].M, self.out, *self.extra]

    def states(self, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Both states at each place, with a row of ones: (T, 2H + 1, B). ``keep`` gets what training needs."""
        T, B = ids.shape
        H, E = self.cells[0].hidden, self.cells[0].embedded
        both = np.empty((T, 2 * H + 1, B), dtype=F32)
        both[:, -1] = 1
        for way, cell in enumerate(self.cells):
            Z = np.empty((H + E + 1, B), dtype=F32)
            Z[-1] = 1
            A = np.empty((4 * H, B), dtype=F32)
            state = [np.zeros((H, B), dtype=F32) for _ in range(cell.carries)]
            for t in range(T) if way == 0 else range(T - 1, -1, -1):
                Z[:H] = state[0]
                np.take(self.embedding, ids[t], axis=1, out=Z[H : H + E], mode="clip")
                before = state[1].copy() if keep is not None and len(state) > 1 else None
                both[t, way * H : way * H + H] = cell.step(Z, A, state)
                if keep is not None:
                    keep.append((way, t, Z.copy(), A.copy(), [before, state[1].copy()] if before is not None else []))
        return both

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Linear outputs (T, classes, B)."""
        return np.matmul(self.out, self.states(ids))

    def train(self, ids: np.ndarray, loss, rate: float) -> float:
        """One step of Adam. ``loss`` maps outputs to (value, their gradient, gradients of ``extra``)."""
        kept: list = []
        both = self.states(ids, kept)
        value, dout, dextra = loss(np.matmul(self.out, both))
        dout = dout.astype(F32)
        H, E = self.cells[0].hidden, self.cells[0].embedded
        grads = [np.zeros_like(p) for p in self.parameters()]
        grads[3] += np.einsum("tcb,thb->ch", dout, both, optimize=True)
        dboth = np.matmul(self.out.T, dout)
        demb = np.zeros((self.embedding.shape[1], E), dtype=F32)
        dh, carry, last = None, [None], None
        for way, t, Z, A, cells in reversed(kept):
            cell = self.cells[way]
            if way != last:
                dh, carry, last = np.zeros((H, Z.shape[1]), dtype=F32), [np.zeros((H, Z.shape[1]), dtype=F32)], way
            d, direct = cell.back(dh + dboth[t, way * H : way * H + H], Z, A, cells, carry)
            grads[1 + way] += d @ Z.T
            dZ = cell.M.T @ d
            dh = direct + dZ[:H]
            np.add.at(demb, ids[t], dZ[H : H + E].T)
        grads[0] += demb.T
        for k in (0, 1):
            grads[1 + k] *= self.cells[k].mask
        for k, g in enumerate(dextra):
            grads[4 + k] += g
        self._adam(grads, rate)
        return value

    def _adam(self, grads: list[np.ndarray], rate: float) -> None:
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        if self._moments is None:
            self._moments = [np.zeros_like(g) for g in grads for _ in (0, 1)]
        self._steps += 1
        for k, (p, g) in enumerate(zip(self.parameters(), grads, strict=True)):
            g = g * scale
            m, v = self._moments[2 * k], self._moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**self._steps)) / (np.sqrt(v / (1 - 0.99**self._steps)) + 1e-7)).astype(p.dtype)

    def frozen(self) -> Bidirectional:
        """Without what only training needs."""
        self._moments = None
        return self


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = x - x.max(axis=axis, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=axis, keepdims=True)
    return x


class Windows:
    """Windows over joined sequences: a core of its own each, and context on either side.

    ``sequence`` and ``begin`` say where each core lies; batches come in order of length.
    """

    def __init__(self, lengths: np.ndarray, core: int, context: int):
        counts = -(-lengths // core)
        self.sequence = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.begin = nth * core
        self.size = np.minimum(core, lengths[self.sequence] - self.begin)
        self.left = np.minimum(context, self.begin)
        self.span = self.left + self.size + np.minimum(context, lengths[self.sequence] - self.begin - self.size)
        self.offset = (np.cumsum(lengths) - lengths)[self.sequence]

    def batches(self, symbols: np.ndarray, pad: int, batch: int):
        """(windows, ids (T, B)): each window starts ``left`` before its core."""
        order = np.argsort(-self.span, kind="stable")
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            T = int(self.span[own[0]])
            place = np.arange(T)[:, None]
            index = (self.offset + self.begin - self.left)[own][None, :] + place
            ids = symbols[np.minimum(index, len(symbols) - 1)].astype(np.intp)
            ids[place >= self.span[own][None, :]] = pad
            yield own, ids
