"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinfabric.llm.shared import discard, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` as a written table, and their number and an order-free sum of their hashes, seen while they are written."""
    seen = Observation(f"edges-{uuid.uuid4().hex[:12]}")
    hashes = F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0)).alias("h")
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes), "edges")
    return table, (seen.get["n"], seen.get["h"])


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b long) -> (id, component): the smallest id that each id of an edge reaches, for ids that aren't it themselves.

    Self-loops, repeats and rows with a null are ignored. Minimum per node is pre-aggregated before the shuffle, and
    a hub's rows are split by AQE's skew join; the two star steps keep the number of edges, so no neighbour list grows.
    Raises if it has not settled after ``rounds`` rounds (the number grows with the log of the size).
    """
    edges, seen = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, last = edges, seen
        edges, seen = _written(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        discard(before)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """:func:`roots`, and the smallest ids themselves; ids without an edge to another id are not returned."""
    found = roots(edges, rounds)
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
