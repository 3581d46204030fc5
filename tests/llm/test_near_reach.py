"""The index reaches as far as the threshold needs."""

import itertools

import numpy as np

from kinfabric.llm import minhash_dedup as near


def test_reach_follows_the_threshold(spark):
    assert near.chunks_for(85) == 10 and near.chunks_for(80) == 12
    assert near.places_of(10) == [tuple(c * 5 + p for p in x) for c in range(10) for x in itertools.combinations(range(5), 4)]
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 16, near.POSITIONS).astype(np.uint16)
    rows = [(0, one.tobytes())]
    for i in range(1, 200):
        other = one.copy()
        other[rng.choice(near.POSITIONS, 23, replace=False)] ^= 1
        rows.append((i, other.tobytes()))
    keys = near.index_keys(spark.createDataFrame(rows, "id long, sig binary"), near.places_of(12))
    mine = keys.where("id = 0").select("key")
    assert keys.where("id > 0").join(mine, "key").select("id").distinct().count() == 199
