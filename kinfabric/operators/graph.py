"""Property graphs as DataFrames: mutation, neighbours, paths, degrees, clustering, components."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfabric.plans.lineage import discard, written

DIRECTIONS = ("all", "outgoing", "incoming", "undirected")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, nbr, direction), without repeats; an undirected edge has both directions."""
    rows = edges.select(
        F.explode(
            F.when(
                F.col("directed"),
                F.array(
                    F.struct(F.col("source").alias("node_id"), F.col("target").alias("nbr"), F.lit("outgoing").alias("direction")),
                    F.struct(F.col("target").alias("node_id"), F.col("source").alias("nbr"), F.lit("incoming").alias("direction")),
                ),
            ).otherwise(
                F.array(
                    F.struct(F.col("source").alias("node_id"), F.col("target").alias("nbr"), F.lit("undirected").alias("direction")),
                    F.struct(F.col("target").alias("node_id"), F.col("source").alias("nbr"), F.lit("undirected").alias("direction")),
                )
            )
        ).alias("x")
    )
    return rows.select("x.*").distinct()


@dataclass
class Graph:
    """An immutable graph; ``nodes`` have node_id and node_ord, ``edges`` source, target and directed.

    ``links`` are the neighbours of any direction, if they have been written (:meth:`stored`).
    """

    nodes: DataFrame
    edges: DataFrame
    links: DataFrame | None = None

    def stored(self) -> Graph:
        """The same graph with its edges and neighbours written once, for operators that read them often."""
        kept = Graph(self.nodes, written(self.edges, "edges"))
        return Graph(kept.nodes, kept.edges, written(kept.neighbors(), "links"))

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Graph:
        from kinfabric.sources.graph_io import read_graph_json

        return cls(*read_graph_json(spark, path))

    def clear(self) -> Graph:
        return Graph(self.nodes.limit(0), self.edges.limit(0))

    def add_nodes(self, new: DataFrame) -> Graph:
        """Nodes whose id exists are left out; the first of repeated ones wins."""
        fresh = first_wins(new, ["node_id"], "node_ord").join(self.nodes.select("node_id"), "node_id", "left_anti")
        return Graph(self.nodes.unionByName(fresh, allowMissingColumns=True), self.edges)

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Without the nodes in ``ids`` (node_id) and their edges."""
        gone = ids.select("node_id")
        edges = self.edges.join(gone, self.edges["source"] == gone["node_id"], "left_anti")
        edges = edges.join(gone, edges["target"] == gone["node_id"], "left_anti")
        return Graph(self.nodes.join(gone, "node_id", "left_anti"), edges)

    def add_edges(self, new: DataFrame, order: str = "edge_ord", check: bool = True) -> Graph:
        """Edges whose ordered key exists are left out; raises where an endpoint is missing."""
        if check and not self.dangling(new).isEmpty():
            raise ValueError("an edge needs both of its nodes")
        fresh = first_wins(new, ["source", "target"], order).join(self.edges.select("source", "target"), ["source", "target"], "left_anti")
        return Graph(self.nodes, self.edges.unionByName(fresh, allowMissingColumns=True))

    def remove_edges(self, keys: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(keys.select("source", "target"), ["source", "target"], "left_anti"))

    def dangling(self, edges: DataFrame | None = None) -> DataFrame:
        """Edges without one of their nodes."""
        edges, ids = self.edges if edges is None else edges, self.nodes.select("node_id")
        whole = edges.join(ids, edges["source"] == ids["node_id"], "left_semi").select("source", "target")
        whole = whole.join(ids, whole["target"] == ids["node_id"], "left_semi")
        return edges.join(whole, ["source", "target"], "left_anti")

    def get_node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def get_edge(self, source: str, target: str) -> DataFrame:
        return self.edges.where((F.col("source") == source) & (F.col("target") == target))

    def neighbors(self, direction: str = "all") -> DataFrame:
        """(node_id, nbr); an unknown direction has no rows."""
        if direction == "all" and self.links is not None:
            return self.links
        rows = adjacency(self.edges)
        if direction != "all":
            rows = rows.where(F.col("direction") == direction)
        return rows.select("node_id", "nbr").distinct()

    def counts(self) -> DataFrame:
        n = self.nodes.agg(F.count("*").alias("node_count"))
        return n.join(F.broadcast(self.edges.select("source", "target").distinct().agg(F.count("*").alias("edge_count"))))

    def degrees(self) -> DataFrame:
        """(node_id, node_ord, degree): distinct neighbours, 0 for isolated nodes."""
        d = self.neighbors().groupBy("node_id").agg(F.count("*").alias("degree"))
        return self.nodes.select("node_id", "node_ord").join(d, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def paths(self, source: str, target: str, max_steps: int) -> DataFrame:
        """(path): simple paths over neighbours of all directions, of at most ``max_steps`` nodes.

        ``max_steps`` 1 still gives direct edges, 0 nothing; a node to itself is a path of one.
        """
        spark = self.nodes.sparkSession
        here = self.nodes.where(F.col("node_id").isin(source, target)).select("node_id").distinct()
        known = here.agg(F.count("*").alias("n")).where(F.lit(len({source, target})) == F.col("n"))
        start = known.select(F.array(F.lit(source)).alias("path"))
        if source == target:
            return start
        hops = max(1, max_steps - 1) if max_steps >= 1 else 0
        if not hops:
            return spark.createDataFrame([], "path array<string>")
        # half of the hops from each end, which meet in the middle: the work follows the paths found
        links, found = written(self.neighbors(), "links") if self.links is None else self.links, []

        def walked(begin: str, end: str, n: int) -> list[DataFrame]:
            """Simple paths from ``begin`` of 0 to n hops that keep away from ``end``."""
            out = [known.select(F.array(F.lit(begin)).alias("path"))]
            for _ in range(n):
                far = out[-1].join(links, F.element_at("path", -1) == links["node_id"]).where((F.col("nbr") != end) & ~F.array_contains("path", F.col("nbr")))
                out.append(written(far.select(F.concat("path", F.array("nbr")).alias("path")), "paths"))
            return out

        ahead, back = walked(source, target, hops // 2), walked(target, source, hops - hops // 2)
        direct = known.join(links.where((F.col("node_id") == source) & (F.col("nbr") == target)).limit(1))
        found.append(direct.select(F.array(F.lit(source), F.lit(target)).alias("path")))
        bare = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)  # noqa: E731  without the node where the halves meet
        for n in range(2, hops + 1):
            one = ahead[n // 2].withColumn("at", F.element_at("path", -1))
            two = back[n - n // 2].select(F.col("path").alias("rest"), F.element_at("path", -1).alias("at"))
            met = one.join(two, "at").where(~F.arrays_overlap(bare(F.col("path")), F.col("rest")))
            found.append(met.select(F.concat("path", F.reverse(bare(F.col("rest")))).alias("path")))
        return reduce(DataFrame.unionByName, found)

    def oriented(self, orientation: str = "any") -> tuple[DataFrame, DataFrame]:
        """(u, v, way) and (node_id, k, number), written: linked pairs from the node of fewer neighbours k to that of more, by their numbers."""
        edges = self.edges.select("source", "target")
        way = F.lit(True) if orientation == "any" else F.col("source") < F.col("target")
        ends = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
        pairs = written(edges.where("source <> target").groupBy(*ends).agg(F.max(way).alias("way")), "pairs")
        ks = pairs.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("k"))
        numbers = written(ks.orderBy("k", "node_id").withColumn("number", F.monotonically_increasing_id()), "numbers")
        of = lambda side, name: numbers.select(F.col("node_id").alias(side), F.col("number").alias(name))
        rows = pairs.join(of("a", "i"), "a").select("i", "b", "way").join(of("b", "j"), "b")
        rows = written(rows.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "way"), "oriented")
        discard(pairs)
        return rows, numbers

    def clustering(self, orientation: str = "ordered") -> DataFrame:
        """(node_id, clustering): linked pairs of neighbours over all pairs.

        ``ordered`` counts a pair i < j only by an edge from i to j; ``any`` by an edge of either way. Each pair of
        linked nodes u, v points to the one of more neighbours (v); a triangle is found once, from its pair u, v
        and a node that v points to. A node points to at most the square root of twice the number of pairs, so hubs
        make no wedges. Nodes are numbered by their number of neighbours, so that only numbers are joined.
        """
        edges = self.edges.select("source", "target")
        rows, numbers = self.oriented(orientation)
        wedges = rows.join(rows.toDF("v", "w", "far"), "v")
        found = wedges.join(rows.toDF("u", "w", "long"), ["u", "w"])
        # a node is closed by the pair on the other side of the triangle
        each = F.explode(F.array(*[F.struct(F.col(n).alias("number"), F.col(c).cast("long").alias("n")) for n, c in (("w", "way"), ("u", "far"), ("v", "long"))])).alias("x")
        closed = written(found.select(each).groupBy("x.number").agg(F.sum("x.n").alias("closed")), "closed")
        discard(rows)
        loops = edges.where("source = target").select(F.col("source").alias("node_id"), F.lit(1).alias("loop")).distinct()
        out = self.nodes.select("node_id").join(numbers, "node_id", "left").join(loops, "node_id", "left").join(closed, "number", "left")
        # a self-loop makes the node its own neighbour
        k = F.coalesce("k", F.lit(0)) + F.coalesce("loop", F.lit(0))
        value = F.when(k < 2, 0.0).otherwise(F.coalesce("closed", F.lit(0)) / (k * (k - 1) / 2))
        return out.select("node_id", value.cast("double").alias("clustering"))

    def components(self, rounds: int = 100) -> DataFrame:
        """(node_id, component): the smallest node_id reachable over edges of any direction."""
        links = self.links if self.links is not None else written(self.neighbors(), "links")
        labels = written(self.nodes.select("node_id", F.col("node_id").alias("component")), "labels")
        for _ in range(rounds):
            low = links.join(labels.toDF("nbr", "c"), "nbr").groupBy("node_id").agg(F.min("c").alias("c"))
            new = labels.join(low, "node_id", "left").select("node_id", F.least("component", F.coalesce("c", "component")).alias("component"))
            jump = new.join(new.toDF("component", "further"), "component", "left")
            new = written(jump.select("node_id", F.coalesce("further", "component").alias("component")), "labels")
            settled = new.join(labels.toDF("node_id", "old"), "node_id").where("component <> old").isEmpty()
            discard(labels)
            if settled:
                return new
            labels = new
        raise RuntimeError("components have not settled")

    def __repr__(self) -> str:
        return f"Graph(nodes: {', '.join(self.nodes.columns)}; edges: {', '.join(self.edges.columns)})"


def top(df: DataFrame, score: str | Column, k: int, descending: bool = True, tie: str = "node_ord") -> DataFrame:
    c = F.col(score) if isinstance(score, str) else score
    return df.orderBy(c.desc() if descending else c.asc(), tie).limit(k)
