"""Counters and times of an engine's requests, as JSON or in the text format of Prometheus."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

#: Upper bounds of the buckets that times are counted in, in seconds.
BOUNDS = (0.01, 0.1, 1.0, 10.0, 100.0)


class Metrics:
    def __init__(self, prefix: str = "siltstone"):
        self.prefix, self.lock = prefix, threading.Lock()
        self.counters: dict[str, int] = {}
        self.times: dict[str, list[float]] = {}

    def add(self, name: str, n: int = 1) -> None:
        with self.lock:
            self.counters[name] = self.counters.get(name, 0) + n

    @contextmanager
    def timed(self, kind: str) -> Iterator[None]:
        """Counts a request of a kind, its time, and whether it failed."""
        began = time.perf_counter()
        try:
            yield
        except Exception:
            self.add(f"{kind}_errors")
            raise
        finally:
            took = time.perf_counter() - began
            with self.lock:
                held = self.times.setdefault(kind, [0.0] * (len(BOUNDS) + 2))  # buckets, count, sum
                for k, bound in enumerate(BOUNDS):
                    held[k] += took <= bound
                held[-2] += 1
                held[-1] += took

    def as_dict(self) -> dict:
        with self.lock:
            return {"counters": dict(sorted(self.counters.items())), "requests": {k: {"count": int(v[-2]), "seconds": round(v[-1], 6)} for k, v in sorted(self.times.items())}}

    def prometheus(self) -> str:
        with self.lock:
            lines = []
            for name, n in sorted(self.counters.items()):
                lines += [f"# TYPE {self.prefix}_{name}_total counter", f"{self.prefix}_{name}_total {n}"]
            if self.times:
                lines.append(f"# TYPE {self.prefix}_request_seconds histogram")
            for kind, held in sorted(self.times.items()):
                lines += [f'{self.prefix}_request_seconds_bucket{{kind="{kind}",le="{b:g}"}} {int(n)}' for b, n in zip(BOUNDS, held, strict=False)]
                lines += [f'{self.prefix}_request_seconds_bucket{{kind="{kind}",le="+Inf"}} {int(held[-2])}', f'{self.prefix}_request_seconds_count{{kind="{kind}"}} {int(held[-2])}', f'{self.prefix}_request_seconds_sum{{kind="{kind}"}} {held[-1]:.6f}']
            return "\n".join(lines) + "\n"
