"""Compact windows and their intervals against all subsequences, and the operator with one hash function and with several."""

import numpy as np
import pytest

from tidewire.llm import spans
from tidewire.sources.tables import table


def test_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        values = rng.integers(0, rng.integers(1, 30), n).astype(np.uint64)
        seen = {}
        for left, first, last, right in spans.compact_windows(values, width).tolist():
            for i in range(left, last + 1):
                for j in range(max(first, i + width - 1), right + 1):
                    assert (i, j) not in seen
                    seen[i, j] = values[first]
        starts = max(0, n - width + 1)
        assert len(seen) == starts * (starts + 1) // 2
        assert all(v == values[i : j + 1].min() for (i, j), v in seen.items())


def test_windows_are_few():
    values = np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64)
    assert len(spans.compact_windows(values, 269)) < 2.3 * 100_000 / 269
    assert len(spans.compact_windows(np.zeros(100_000, np.uint64), 269)) == 1


def test_intervals_cover_all_starts():
    rng = np.random.default_rng(2)
    sizes = np.array([40, 3, 9, 10, 200])
    points = rng.integers(97, 100, sizes.sum()).astype(np.uint32)
    doc, first, last, mark = spans.intervals(points, sizes, 10, 4)
    for d, n in enumerate(sizes):
        on = doc == d
        assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first[on], last[on], strict=True)] or [[]]).tolist() == list(range(n - 9))
    texts = np.split(points, np.cumsum(sizes)[:-1])
    of = {}
    for d, a, b, m in zip(doc, first, last, mark, strict=True):
        for k in range(a, b + 1):
            assert of.setdefault(texts[d][k : k + 10].tobytes(), m) == m  # equal stretches have equal signatures


@pytest.mark.parametrize("hashes", [1, 4])
def test_any_number_of_hashes_gives_the_same(spark, hashes):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert {tuple(r) for r in spans.shared_spans(docs, hashes=hashes).collect()} == {tuple(r) for r in spans.shared_spans(docs).collect()}
