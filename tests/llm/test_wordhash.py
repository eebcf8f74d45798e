"""Word and shingle hashes of long texts: windows of any length give the same ones, in little memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wordweave.llm import wordhash


def _all(column, k):
    out = []
    for w in wordhash.slices(column, lower=True, size=1 << 40):
        hashes, ok = w.shingles(k)
        out.append([x.tolist() for x in (w.start, w.end, w.first, w.hash, hashes, ok)])
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 7, 16, 64])
def test_windows_change_no_hash(monkeypatch, window):
    rng = random.Random(window)
    texts = ["", None, "one", "ab" * 40, " \t\n", "é" * 30 + " x"]
    texts += ["".join(rng.choice(["a", "B", "é", " ", "\n", "xyz" * 9]) for _ in range(rng.randrange(60))) for _ in range(150)]
    column = pa.array(texts, pa.string())
    whole = {k: _all(column, k) for k in (1, 2, 4)}
    monkeypatch.setattr(wordhash, "SLICE", window)
    monkeypatch.setattr(wordhash, "STARTS", window)
    assert {k: _all(column, k) for k in (1, 2, 4)} == whole


def test_hashes_tell_words_and_documents_apart():
    (w,) = wordhash.slices(pa.array(["same words here", "here same", "Same words here", None, "samewords"]))
    assert w.first.tolist() == [0, 3, 5, 8, 8, 9]
    assert w.hash[0] == w.hash[4] and w.hash[2] == w.hash[3] == w.hash[7]
    assert len(set(w.hash.tolist())) == 5
    hashes, ok = w.shingles(3)
    assert ok.tolist() == [True, False, False, False, False, True, False, False, False] and hashes[0] != hashes[5]


def test_a_long_text_takes_few_bytes_a_byte():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 20_000_000, dtype=np.uint8)
    raw[rng.integers(0, len(raw), len(raw) // 6)] = 32
    column = pa.array([raw.tobytes().decode()], pa.large_string())
    tracemalloc.start()
    for w in wordhash.slices(column):
        w.shingles(4)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 12 * len(raw)
