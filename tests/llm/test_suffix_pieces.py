"""Groups that are cut into pieces, and texts that cross the seam of a chunk."""

import collections
import hashlib
import random

import numpy as np

from kinfabric.llm import suffix_dedup
from kinfabric.llm.hashing import CHUNK

SCHEMA = "doc_id long, text string, mini long, rk string"


def slow(data):
    counts = collections.Counter(b[s : s + 200] for _, b in data for s in range(len(b) - 199))
    out = []
    for i, b in data:
        hit = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if counts[b[s : s + 200]] > 1:
                hit[s : s + 200] = True
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((i, len(b), int(hit.sum()), int((hit[1:] < hit[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, data):
    frame = spark.createDataFrame([(i, b.decode(), 1, "x") for i, b in data], SCHEMA).repartition(3)
    return sorted(map(tuple, suffix_dedup.remove_repeats(frame).drop("kept_bytes", "spans").collect()))


def test_a_common_passage_in_different_places(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_ROWS", 2)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(12)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, short = say(80), say(36)[:199]
    data = [(i, f"{say(30)} {passage} {say(30)}".encode()) for i in range(25)]
    data += [(i, f"{say(20)} {short} {say(20)}".encode()) for i in range(25, 35)]
    data += [(90, b"a" * 900), (91, b"a" * 250), (92, b"ab " * 200), (93, passage.encode()[:200])]
    want = slow(data)
    assert sum(r[2] > 0 for r in want) >= 27
    assert found(spark, data) == want


def test_a_repeat_across_the_seam(spark):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, CHUNK + 5000, dtype=np.uint8))
    other = bytes(rng.integers(65, 91, 400, dtype=np.uint8))
    at = CHUNK - 150
    data = [(1, text), (2, other + text[at : at + 310] + other[::-1])]
    got = found(spark, data)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, len(text), 310, 1), (2, 1110, 310, 1)]
    assert got[0][4] == hashlib.sha256(text[:at] + text[at + 310 :]).hexdigest()
