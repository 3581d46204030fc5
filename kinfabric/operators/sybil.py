"""Sybil detection: random walks and trust propagation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfabric.functions.rng import hash_int
from kinfabric.functions.text import display_name
from kinfabric.operators import propagation
from kinfabric.operators.graph import Graph, top
from kinfabric.plans.lineage import discard, written

#: Steps of walks in one plan; walks that are broadcast at most.
STEPS_PER_TABLE, MOST_BROADCAST = 8, 200_000


def numbered_neighbors(graph: Graph) -> DataFrame:
    """(node_id, i, nbr, fan), written: a node's neighbours of any direction, numbered from 0 in order of id; fan is nbr's own number of them."""
    nbrs = graph.neighbors()
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("nbr")) - 1
    fan = nbrs.groupBy(F.col("node_id").alias("nbr")).agg(F.count("*").alias("fan"))
    return written(nbrs.withColumn("i", place).join(fan, "nbr").select("node_id", "i", "nbr", "fan"), "numbered")


def walks(graph: Graph, seeds: DataFrame, per_seed: int, length: int, seed: int = 7) -> DataFrame:
    """(seed, walk_id, step, node): uniform walks of ``length`` nodes that stop at a node without neighbours.

    Each step takes the neighbour, in order of id, at the place that a hash of seed, walk and step gives. A
    neighbour has one itself, so only walks from an isolated seed stop. The neighbours stay where they are and
    meet the walks by (node, place): walks are broadcast up to ``MOST_BROADCAST`` of them, beyond they are joined.
    """
    steps = numbered_neighbors(graph).persist()  # read in each step; a lost part comes from the written table again
    known = written(seeds.join(graph.nodes.select("node_id"), "node_id", "left_semi").distinct(), "walk-seeds")
    small = known.count() * per_seed <= MOST_BROADCAST
    fan = steps.groupBy(F.col("node_id").alias("seed")).agg(F.count("*").alias("fan"))
    rows = known.select(F.col("node_id").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1))).alias("walk_id"))
    rows = written(rows.join(fan, "seed", "left").select("seed", "walk_id", F.array("seed").alias("path"), F.col("seed").alias("at"), "fan"), "walks")
    alone, rows = rows.where("fan IS NULL"), rows.where("fan IS NOT NULL")
    for step in range(1, length):
        place = (hash_int(seed, F.col("seed"), F.col("walk_id"), step) % F.col("fan")).cast("int")
        rows = rows.select("seed", "walk_id", "path", F.col("at").alias("node_id"), place.alias("i"))
        rows = steps.join(F.broadcast(rows) if small else rows, ["node_id", "i"])
        rows = rows.select("seed", "walk_id", F.concat("path", F.array("nbr")).alias("path"), F.col("nbr").alias("at"), "fan")
        if step % STEPS_PER_TABLE == 0:
            rows = written(rows, "walks")
    rows = written(rows.union(alone), "walks")
    steps.unpersist()
    discard(steps)
    return rows.select("seed", "walk_id", F.posexplode("path").alias("step", "node"))


def select_seeds(graph: Graph, k: int, method: str = "degree", manual: list[str] | None = None, seed: int = 7) -> DataFrame:
    """(node_id): ``degree``, ``random``, ``clustering``, ``betweenness`` or ``manual``; ties by node_ord."""
    nodes = graph.nodes.select("node_id", "node_ord")
    if method == "manual":
        if manual and len(manual) > k:
            warnings.warn("manual seeds are all used, also beyond k", stacklevel=2)
        return nodes.where(F.col("node_id").isin(*(manual or [])) if manual else F.lit(False)).select("node_id")
    if method == "degree":
        rows = graph.degrees().withColumn("score", F.col("degree"))
    elif method == "random":
        rows = nodes.withColumn("score", -hash_int(seed, "seeds", F.col("node_id")))
    elif method == "clustering":
        rows = nodes.join(graph.clustering(), "node_id").withColumn("score", F.col("clustering"))
    elif method == "betweenness":
        rows = nodes.join(betweenness(graph, seed=seed), "node_id").withColumn("score", F.col("betweenness"))
    else:
        raise ValueError(f"no such seed selection: {method}")
    return top(rows, "score", k).select("node_id")


def betweenness(graph: Graph, sources: int = 50, per_source: int = 10, length: int = 15, seed: int = 7) -> DataFrame:
    """(node_id, betweenness): visits inside walks from the first nodes, over the largest number."""
    first = graph.nodes.orderBy("node_ord").limit(sources).select("node_id")
    rows = walks(graph, first, per_source, length, seed)
    last = F.max("step").over(Window.partitionBy("seed", "walk_id"))
    inner = rows.withColumn("last", last).where("step > 0 AND step < last").groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("visits"))
    most = inner.agg(F.max("visits").alias("most"))
    rows = graph.nodes.select("node_id").join(inner, "node_id", "left").join(F.broadcast(most))  # one row
    return rows.select("node_id", F.coalesce(F.col("visits") / F.when(F.col("most") > 0, F.col("most")), F.lit(0.0)).alias("betweenness"))


# Walk reach, degree and clustering ("guard")


def path_diversity(graph: Graph, rows: DataFrame) -> DataFrame:
    """(node_id, diversity): the share of seeds with a walk through the node."""
    n = rows.agg(F.countDistinct("seed").alias("seeds"))
    reach = rows.groupBy(F.col("node").alias("node_id")).agg(F.countDistinct("seed").alias("reached"))
    out = graph.nodes.select("node_id", "node_ord").join(reach, "node_id", "left").join(F.broadcast(n))  # one row
    return out.select("node_id", "node_ord", F.coalesce(F.col("reached") / F.col("seeds"), F.lit(0.0)).alias("diversity"))


def attack_edges(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """(source, target, frequency): ordered steps whose number over that of walks is above ``least``."""
    following = F.lead("node").over(Window.partitionBy("seed", "walk_id").orderBy("step"))
    steps = rows.withColumn("target", following).where("target IS NOT NULL").groupBy(F.col("node").alias("source"), "target").agg(F.count("*").alias("n"))
    total = rows.select("seed", "walk_id").distinct().agg(F.count("*").alias("walks"))
    out = steps.join(F.broadcast(total)).select("source", "target", (F.col("n") / F.col("walks")).alias("frequency"))
    return out.where(F.col("frequency") > least)


def guard_scores(graph: Graph, rows: DataFrame) -> DataFrame:
    """(node_id, node_ord, score): low diversity, odd degree and low clustering add up to suspicion."""
    degrees = graph.degrees().select("node_id", "degree")
    mean = degrees.agg(F.avg("degree").alias("mean"))
    parts = path_diversity(graph, rows).join(degrees, "node_id").join(graph.clustering(), "node_id").join(F.broadcast(mean))
    ratio = F.col("degree") / F.col("mean")
    odd = F.when(F.col("degree") == 0, 0.0).when((ratio > 3) | (ratio < 0.3), 0.3).otherwise(0.3 * (1 - F.least(ratio / 3, F.lit(1.0))))
    score = 0.4 * (1 - F.col("diversity")) + odd + 0.3 * (1 - F.col("clustering"))
    return parts.select("node_id", "node_ord", F.least(score, F.lit(1.0)).alias("score"))


def guard_sybils(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Score at or above the threshold; none and 0 mean 0.7."""
    return scores.where(F.col("score") >= (threshold or 0.7))


# Mixing and balance of walks ("limit")


def mixing(rows: DataFrame) -> DataFrame:
    """(node_id, walks_through, early, late, mixing_ratio, visit_frequency) of nodes on walks."""
    size = F.count("*").over(Window.partitionBy("seed", "walk_id"))
    rows = rows.withColumn("late", F.col("step") >= F.floor(size / 2))
    per = rows.groupBy("seed", "walk_id", F.col("node").alias("node_id")).agg(F.max((~F.col("late")).cast("int")).alias("early"), F.max(F.col("late").cast("int")).alias("late"))
    out = per.groupBy("node_id").agg(F.count("*").alias("walks_through"), F.sum("early").alias("early"), F.sum("late").alias("late"))
    total = rows.select("seed", "walk_id").distinct().agg(F.count("*").alias("walks"))
    out = out.join(F.broadcast(total))
    return out.select("node_id", "walks_through", "early", "late", (F.col("late") / F.col("walks_through")).alias("mixing_ratio"), (F.col("walks_through") / F.col("walks")).alias("visit_frequency"))


def balance(graph: Graph, rows: DataFrame) -> DataFrame:
    """(node_id, node_ord, mixing_ratio, visit_frequency, balance).

    The variance of walks through the node over all seeds, those without included, comes from the sum and
    the sum of squares, so seeds and nodes are never multiplied out.
    """
    per = rows.groupBy("seed", F.col("node").alias("node_id")).agg(F.countDistinct("walk_id").alias("v"))
    seeds = rows.agg(F.countDistinct("seed").alias("seeds"))
    sums = per.groupBy("node_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    out = graph.nodes.select("node_id", "node_ord").join(sums, "node_id", "left").join(mixing(rows), "node_id", "left").join(F.broadcast(seeds))
    mean = F.col("s") / F.col("seeds")
    spread = (F.col("q") / F.col("seeds") - mean * mean) / (mean * mean)
    ratio = F.coalesce("mixing_ratio", F.lit(0.0))
    value = F.when(F.col("s") > 0, F.least(1 / (1 + spread) + 0.3 * ratio, F.lit(1.0))).otherwise(0.0)
    return out.select("node_id", "node_ord", ratio.alias("mixing_ratio"), F.coalesce("visit_frequency", F.lit(0.0)).alias("visit_frequency"), value.alias("balance"))


def acceptance(graph: Graph, rows: DataFrame) -> DataFrame:
    value = 0.6 * F.col("balance") + 0.3 * F.least(2 * F.col("visit_frequency"), F.lit(1.0)) + 0.1 * F.col("mixing_ratio")
    return balance(graph, rows).select("node_id", "node_ord", F.least(value, F.lit(1.0)).alias("acceptance"))


def average_acceptance(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("acceptance").alias("average"))


def limit_sybils(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    return scores.where(F.col("acceptance") < F.lit(1.0 - (threshold or 0.8)))


# Random walk with restart ("rank")


def propagate(graph: Graph, seeds: DataFrame, damping: float = 0.85, iterations: int = 100, epsilon: float = 1e-6, fixed: bool = False) -> DataFrame:
    """(node_id, node_ord, trust): trust flows evenly to neighbours and restarts at the seeds.

    Stops where the step is shorter than epsilon and keeps the vector before it; with ``fixed``, all
    iterations run. Nodes without neighbours leak. Only the lengths of steps come to the driver.
    """
    return propagation.ranks(graph, seeds, damping, iterations, epsilon, fixed)


def rank_scores(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("score", 1 - F.col("trust"))


def rank_sybils(ranks: DataFrame, threshold: float | None = None) -> DataFrame:
    return rank_scores(ranks).where(F.col("score") >= 1 - (threshold or 0.1))


def rank_honest(ranks: DataFrame, threshold: float | None = None) -> DataFrame:
    return ranks.where(F.col("trust") >= (threshold or 0.1))


def with_names(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """``scores`` with ``name`` from the nodes' metadata (JSON): first and last name, Unknown where one is missing."""
    part = lambda key: F.get_json_object("metadata", f"$.{key}")
    named = nodes.select("node_id", display_name(part("first_name"), part("last_name")).alias("name"))
    return scores.join(named, "node_id", "left")


def trust_stats(ranks: DataFrame, threshold: float = 0.1) -> DataFrame:
    return ranks.agg(
        F.avg("trust").alias("mean"), F.median("trust").alias("median"), F.stddev_pop("trust").alias("std"), F.min("trust").alias("low"),
        F.max("trust").alias("high"), F.count_if(F.col("trust") >= threshold).alias("trusted"), F.count("*").alias("total"),
    )


@dataclass
class Detection:
    """What a detector finds, as DataFrames."""

    seeds: DataFrame
    scores: DataFrame
    sybils: DataFrame
    more: dict[str, DataFrame]

    def ratio(self) -> DataFrame:
        total = self.scores.agg(F.count("*").alias("total"))
        return self.sybils.agg(F.count("*").alias("found")).join(F.broadcast(total)).select("found", "total", F.coalesce(F.col("found") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("ratio"))


def detect_guard(graph: Graph, k: int = 10, method: str = "degree", per_seed: int = 100, length: int = 20, threshold: float | None = None, **seeds) -> Detection:
    graph = graph.stored()
    chosen = written(select_seeds(graph, k, method, **seeds), "seeds")
    rows = written(walks(graph, chosen, per_seed, length), "walks")
    scores = guard_scores(graph, rows)
    return Detection(chosen, scores, guard_sybils(scores, threshold), {"walks": rows, "attack_edges": attack_edges(rows)})


def detect_limit(graph: Graph, k: int = 10, method: str = "degree", per_seed: int = 100, length: int = 25, threshold: float | None = None, **seeds) -> Detection:
    graph = graph.stored()
    chosen = written(select_seeds(graph, k, method, **seeds), "seeds")
    rows = written(walks(graph, chosen, per_seed, length), "walks")
    scores = acceptance(graph, rows)
    return Detection(chosen, scores, limit_sybils(scores, threshold), {"walks": rows, "mixing": mixing(rows), "balance": balance(graph, rows), "average": average_acceptance(scores)})


def detect_rank(graph: Graph, k: int = 10, method: str = "degree", threshold: float | None = None, damping: float = 0.85, **seeds) -> Detection:
    graph = graph.stored()
    chosen = written(select_seeds(graph, k, method, **seeds), "seeds")
    ranks = propagate(graph, chosen, damping)
    return Detection(chosen, rank_scores(ranks), rank_sybils(ranks, threshold), {"ranks": ranks, "nodes": graph.nodes, "honest": rank_honest(ranks, threshold), "stats": trust_stats(ranks)})
