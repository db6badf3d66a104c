"""Very long texts: time and memory that grow with their words, not more."""

from __future__ import annotations

import time
import tracemalloc

import pytest

from siltstone.llm import common, decontam, repeats, simhash_dedup

LONG = b" ".join(b"word%d" % (k * 7919 % 100_003) for k in range(1_500_000))


@pytest.mark.parametrize(
    "work",
    [
        lambda: simhash_dedup.fingerprints([LONG]),
        lambda: repeats.anchors(common.words_of([LONG])),
        lambda: decontam.Probe([1], ["word7919 word15838 word23757 word31676 word39595 word47514 word55433 word63352"]).found([LONG]),
    ],
    ids=["fingerprint", "anchors", "decontamination"],
)
def test_one_long_text(work):
    common.powers(len(LONG))
    tracemalloc.start()
    began = time.monotonic()
    work()
    took, peak = time.monotonic() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 120 and peak < 40 * len(LONG)
