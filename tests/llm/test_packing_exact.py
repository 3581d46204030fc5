"""Bucket boundaries are the best ones for long documents too."""

import numpy as np

from kinfabric.llm import packing


def slow_least(edges, counts, buckets):
    """The least sum of padded lengths, by plain dynamic programming."""
    total = np.concatenate(([0], np.cumsum(counts)))
    best = [0] + [np.inf] * len(edges)
    for _ in range(buckets):
        best = [0] + [min(best[i] + edges[j - 1] * (total[j] - total[i]) for i in range(j)) for j in range(1, len(edges) + 1)]
    return best[-1]


def cost(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) for x in lengths)


def test_boundaries_are_the_best():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 120):
        for buckets in (1, 2, 5, 16):
            edges = np.sort(rng.choice(30_000, size, replace=False))
            counts = rng.integers(1, 50, size)
            bounds = packing.best_boundaries(edges, counts, buckets)
            assert len(bounds) <= buckets and bounds[-1] == edges[-1]
            assert cost(np.repeat(edges, counts), bounds) == slow_least(edges, counts, buckets)


def test_long_documents_have_the_least_padding(spark):
    rng = np.random.default_rng(5)
    lengths = [1001, 5001, 20_020, *(int(x) for x in rng.integers(200, 20_000, 300))]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    out = packing.pack(rows, buckets=6, budget=40_000).collect()
    edges, counts = np.unique(lengths, return_counts=True)
    assert sum(r.padded for r in out) == slow_least(edges, counts, 6)
    for bucket in {r.bucket for r in out}:
        inside = [r for r in out if r.bucket == bucket]
        assert {r.padded for r in inside} == {max(r.length for r in inside)}
        assert all(r.padding == r.padded - r.length for r in inside)
