"""The registered propagation against a dense one that runs until it settles."""

import numpy as np

from kinfabric.plans.catalog import QUERIES
from tests.test_queries import D


def dense(nodes, links, seeds):
    at = {n: i for i, n in enumerate(nodes)}
    flow = np.zeros((len(nodes), len(nodes)))
    for a, b in links:
        flow[at[b], at[a]] = 1
    flow /= np.maximum(flow.sum(0), 1)
    start = np.array([float(n in seeds) for n in nodes])
    trust = start.copy()
    for _ in range(100):
        new = 0.85 * flow @ trust + 0.15 * start
        if np.linalg.norm(new - trust) < 1e-6:
            break
        trust = new
    return dict(zip(nodes, trust, strict=True))


def test_rank_trust_settles(spark):
    of = lambda name: [tuple(r) for r in QUERIES[name](spark, D).collect()]
    nodes = [r.node_id for r in QUERIES["graph_nodes"](spark, D).collect()]
    want = dense(nodes, of("neighbors_all"), {s for (s,) in of("seeds_degree")})
    got = dict(of("rank_trust"))
    assert got.keys() == want.keys()
    assert max(abs(got[n] - want[n]) for n in nodes) < 1.5e-6
    assert max(abs(v - want[n]) for n, v in of("rank_trust_k10")) > 1e-3
