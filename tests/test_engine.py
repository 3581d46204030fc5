"""Vectors and slow oracles for the graph, sybil, linkage, trust and generator operators."""

import collections
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfabric.functions import text
from kinfabric.operators import composite, gbt, generator, linkage, linkage_run, propagation, sybil, trust, viz
from kinfabric.operators import graph as graph_module
from kinfabric.operators.graph import Graph
from kinfabric.operators.transformer import Encoder, byte_ids, slices
from kinfabric.plans import catalog
from kinfabric.plans.catalog import QUERIES
from kinfabric.sources import graph_io, views


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(f"{i}", i) for i in range(n)], "node_id string, node_ord long")
    rows = [(str(a), str(b), bool(d), i) for i, (a, b, d) in enumerate(edges)]
    return Graph(nodes, spark.createDataFrame(rows, "source string, target string, directed boolean, edge_ord long"))


def trust_of(spark, g, seeds):
    frame = sybil.propagate(g, spark.createDataFrame([(s,) for s in seeds], "node_id string"))
    return [r.trust for r in frame.orderBy("node_ord").collect()]


def test_propagation_vectors(spark):
    path = graph(spark, 4, [(0, 1, False), (1, 2, False)])
    assert np.allclose(trust_of(spark, path, ["0"]), [0.34527047, 0.45945907, 0.19527047, 0], atol=1e-8)
    assert np.allclose(trust_of(spark, graph(spark, 3, [(1, 2, False)]), ["0"]), [0.15, 0, 0])


def test_paths(spark):
    g = graph(spark, 4, [(0, 1, True), (1, 2, True), (0, 2, True), (2, 3, True)])
    found = lambda k, a="0", b="3": sorted(tuple(r.path) for r in g.paths(a, b, k).collect())
    assert found(0) == found(1) == found(2) == []
    assert found(3) == [("0", "2", "3")]
    assert found(4) == [("0", "1", "2", "3"), ("0", "2", "3")]
    assert found(1, "0", "1") == [("0", "1")] and found(3, "0", "0") == [("0",)] and found(3, "0", "9") == []


def test_mutation(spark):
    g = graph(spark, 3, [(0, 1, True), (1, 0, False), (1, 2, True)])
    new = spark.createDataFrame([("0", "1", False, 9), ("2", "0", True, 10), ("2", "0", False, 11)], "source string, target string, directed boolean, edge_ord long")
    assert sorted((r.source, r.target, r.directed) for r in g.add_edges(new).edges.collect()) == [("0", "1", True), ("1", "0", False), ("1", "2", True), ("2", "0", True)]
    with pytest.raises(ValueError):
        g.add_edges(spark.createDataFrame([("0", "7", True, 1)], new.schema))
    left = g.remove_nodes(spark.createDataFrame([("0",)], "node_id string"))
    assert left.nodes.count() == 2 and left.edges.count() == 1
    gone = g.remove_edges(spark.createDataFrame([("1", "0")], "source string, target string"))
    assert gone.edges.count() == 2
    assert g.neighbors("sideways").count() == 0 and g.clear().edges.count() == 0
    assert "Graph(" in repr(g)


def test_clustering_slow(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(45)}
    g = graph(spark, 12, [(a, b, rng.random() < 0.5) for a, b in edges])
    nbrs = {str(i): set() for i in range(12)}
    for a, b in edges:
        nbrs[str(a)].add(str(b))
        nbrs[str(b)].add(str(a))
    keys = {(str(a), str(b)) for a, b in edges}
    for how in ("ordered", "any"):
        got = {r.node_id: r.clustering for r in g.clustering(how).collect()}
        for n, s in nbrs.items():
            s = sorted(s)
            hits = sum((x, y) in keys or (how == "any" and (y, x) in keys) for i, x in enumerate(s) for y in s[i + 1 :] if n not in (x, y) or True)
            k = len(s)
            if n not in s:  # a node with itself as neighbour is left to the SQL tests
                assert got[n] == pytest.approx(0 if k < 2 else hits / (k * (k - 1) / 2))


def test_isolated_node_is_flagged(spark):
    g = graph(spark, 4, [(0, 1, False), (1, 2, False)])
    found = sybil.detect_guard(g, k=1, per_seed=5, length=4)
    assert "3" in [r.node_id for r in found.sybils.collect()]
    steps = {(r.seed, r.walk_id): [] for r in found.more["walks"].collect()}
    for r in found.more["walks"].orderBy("step").collect():
        steps[r.seed, r.walk_id].append(int(r.node))
    assert all(abs(a - b) == 1 for w in steps.values() for a, b in zip(w, w[1:]))
    assert found.ratio().first()["total"] == 4


def subject(i, values):
    return (i, f"s{i}", "x", *values)


def subjects(spark, rows):
    return spark.createDataFrame(rows, "subject_ord long, uuid string, base_id string, " + ", ".join(f"{f} string" for f in linkage.FIELDS))


def test_linkage_vectors(spark):
    """Each vector as log-odds: probabilities near 0 hide a wrong weight."""
    vectors = {
        "0100-0-1": -9.06678379570457,
        "--------": 1e-07,
        "11111111": 26.456748593146717,
        "00000000": -25.44192342965215,
        "0000-110": -8.55293642622473,
        "1-11----": 12.722363408727222,
    }
    for text, odds in vectors.items():
        left = [None if c == "-" else "same" for c in text]
        right = [None if c == "-" else "same" if c == "1" else "other" for c in text]
        got = linkage.pairs(subjects(spark, [subject(0, left), subject(1, right)])).select(linkage.log_odds().alias("o"), linkage.fs_score().alias("p")).first()
        assert got.o == pytest.approx(odds, rel=1e-12) and got.p == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-9)
    bare = linkage.pairs(subjects(spark, [subject(0, ["O'Neil", *[None] * 7]), subject(1, ["oneil", *[None] * 7])]))
    assert bare.select(linkage.fs_score().alias("p")).first().p > 0.89
    void = linkage.pairs(subjects(spark, [subject(0, [None] * 8), subject(1, [None] * 8)]))
    assert void.select(linkage.pattern().alias("k")).first().k == 255


def test_counted_pairs_are_the_made_ones(spark):
    rng = random.Random(9)
    rows = [(i, f"s{i}", f"b{rng.randrange(20)}" if rng.random() < 0.9 else None, *[rng.choice(["a", "A.", "b", "", None]) for _ in linkage.FIELDS]) for i in range(90)]
    people = subjects(spark, rows)
    made = linkage.pairs(people)
    want = {tuple(r) for r in made.groupBy(linkage.pattern().alias("pattern"), linkage.label().alias("label")).count().collect()}
    assert {tuple(r) for r in linkage.pattern_counts(people).collect()} == want
    scored = made.select(linkage.floor4(linkage.fs_score()).alias("s"), F.when(linkage.label() == 1, "Yes").otherwise("No").alias("Match"))
    assert tuple(linkage.fs_accuracy(people).first()) == pytest.approx(tuple(linkage.accuracy_at(scored, "s").first()))
    assert linkage.labelled_pairs(people).count() == made.where(linkage.label() == 1).count()


def test_linkage_run(spark, tmp_path):
    people = views.subjects(spark, "/root/testdata/sf0.001").where("subject_ord < 40")
    models = linkage_run.train(people, epochs=2, max_samples=200)
    models.save(spark, str(tmp_path / "models"))
    composite.register("same_city", lambda rows: rows.withColumn("same_city", (F.col("l.birth_city") == F.col("r.birth_city")).cast("int")))
    out = linkage_run.run(people, linkage_run.Models.load(spark, str(tmp_path / "models")), ["same_city"])
    graph_io.write_results(out.drop("same_city"), str(tmp_path / "results"))
    back = graph_io.read_results(spark, str(tmp_path / "results"))
    assert back.count() == 40 * 39 // 2 and [f.name for f in back.schema][0] == "Row"
    fresh = linkage_run.run(people, models).orderBy("Row").collect()
    for a, b in zip(back.orderBy("Row").collect(), fresh, strict=True):
        assert a.Row == b.Row and a.Composite_Score == pytest.approx(b.Composite_Score) and a.Transformer_Similarity_Score == b.Transformer_Similarity_Score
    table = {r.model: r for r in linkage_run.accuracies(back).collect()}
    assert set(table) == set(linkage_run.SCORES) and table["Composite_Score"].accuracy > 0.9
    assert out.where("same_city = 1").count() > 0
    with pytest.raises(ValueError):
        linkage_run.run(people, models, ["no such"])
    with pytest.raises(ValueError):
        linkage_run.Models.load(spark, str(tmp_path / "none"))
    pairs = linkage.pairs(people)
    p = {(r.subject_ord, r.other): r.gbt for r in models.trees.score(pairs).select("l.subject_ord", F.col("r.subject_ord").alias("other"), "gbt").collect()}
    one, two = (r.asDict() for r in people.orderBy("subject_ord").limit(2).collect())
    assert models.trees.score_pair(one, two) == p[0, 1] and models.trees.predict()[255] == 1


def test_scores_without_sql_by_brute_force(spark):
    """The registered scores of trained models against plain loops over the pairs."""
    d = "/root/testdata/sf0.001"
    people = [r.asDict() for r in views.subjects(spark, d).orderBy("subject_ord").collect()]
    both = [(a, b) for i, a in enumerate(people) for b in people[i + 1 :]]
    code = lambda a, b: sum(1 << i for i, f in enumerate(linkage.FIELDS) if a[f] == b[f])
    counts = collections.Counter((code(a, b), int(a["base_id"] == b["base_id"])) for a, b in both)
    x = np.array([[(p >> i) & 1 for i in range(8)] for (p, _), n in sorted(counts.items()) for _ in range(n)], float)
    y = np.array([2.0 * t - 1 for (_, t), n in sorted(counts.items()) for _ in range(n)])
    now = np.full(len(y), y.mean())

    def grow(rows, level):
        values = (y - now)[rows]
        best, gain = None, -np.inf
        if level < 3 and len(rows) >= 2 and values.min() < values.max():
            for f in range(8):
                left = x[rows, f] <= 0.5
                if left.all() or not left.any():
                    continue
                g = values.var() - (left.sum() * values[left].var() + (~left).sum() * values[~left].var()) / len(rows)
                if best is None or g > gain + 1e-9 * max(1.0, abs(gain)):
                    best, gain = f, g
        if best is None:
            return [(rows, values.mean())]
        left = x[rows, best] <= 0.5
        return grow(rows[left], level + 1) + grow(rows[~left], level + 1)

    for _ in range(40):
        step = np.zeros(len(y))
        for rows, value in grow(np.arange(len(y)), 0):
            step[rows] = value
        now = now + 0.1 * step
    want = {(int(p @ (1 << np.arange(8))), int(t > 0)): v for p, t, v in zip(x, y, 1 / (1 + np.exp(-4 * now)))}
    got = {(r.pattern, r.label): (r.n, r.gbt) for r in QUERIES["gbt_scores"](spark, d).collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(counts)
    assert all(abs(got[k][1] - want[k]) < 2e-3 for k in got)

    e = Encoder()
    vectors = e.forward(byte_ids([" ".join(str(p[f]) for f in linkage.FIELDS) for p in people]))[0]
    length = np.linalg.norm(vectors, axis=1)
    alike = (vectors @ vectors.T / (np.outer(length, length) + 1e-8) + 1) / 2
    place = {p["uuid"]: i for i, p in enumerate(people)}
    scored = QUERIES["transformer_scores"](spark, d).collect()
    assert len(scored) == len(both) and all(abs(alike[place[r.one], place[r.two]] - r.similarity) < 2e-6 for r in scored)

    rows = QUERIES["composite_scores"](spark, d).collect()
    z, t = np.array([(r.gbt, r.transformer, r.fs) for r in rows]), np.array([r.label for r in rows], float)
    wide = np.hstack([z / z.std(0, ddof=1), np.ones((len(z), 1))])
    w, ridge = np.zeros(4), np.diag([1e-4, 1e-4, 1e-4, 0]) * len(z)
    for _ in range(200):
        p = 1 / (1 + np.exp(-wide @ w))
        w = w - np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + ridge, wide.T @ (p - t) + ridge @ w)
    assert np.abs(1 / (1 + np.exp(-wide @ w)) - [r.composite for r in rows]).max() < 0.01


def test_shares_of_connections_are_exact():
    for n in (0, 1, 1500, 90_000, 123_457):
        share = generator.shares(n)
        assert sum(share.values()) == n
        assert [share[k] for k in ("family", "geographic", "age_cohort", "workplace")] == [n * p // 100 for p in (25, 35, 20, 15)]


def test_composite_is_plain_columns(spark, tmp_path):
    """No function object of Spark ML is shipped to the executors, and the fit is the minimum of the ridge loss."""
    rng = np.random.default_rng(1)
    x = np.round(rng.random((300, 3)), 2)
    x[:, 0] = 0.5  # a score that says nothing
    t = (x[:, 1] + x[:, 2] + rng.normal(0, 0.3, 300) > 1).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(y)) for r, y in zip(x, t)], "gbt double, transformer double, fs double, label int")
    model = composite.fit(rows)
    z = (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0, ddof=1)
    wide, w, ridge = np.hstack([z, np.ones((300, 1))]), np.zeros(3), np.diag([1e-4, 1e-4, 0]) * 300
    for _ in range(50):
        p = 1 / (1 + np.exp(-wide @ w))
        w = w - np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + ridge, wide.T @ (p - t) + ridge @ w)
    scored = composite.score(model, rows)
    assert "UDF" not in scored._jdf.queryExecution().toString()
    assert np.abs(np.array([r.composite for r in scored.collect()]) - 1 / (1 + np.exp(-wide @ w))).max() < 1e-6
    composite.save(spark, model, str(tmp_path / "model"))
    assert composite.load(spark, str(tmp_path / "model")) == model
    one = composite.score(composite.fit(rows.where("label = 1")), rows)
    assert {r.composite for r in one.collect()} == {1.0}


def test_rows_of_more_pairs_than_ints(spark):
    """The last pair of 90,000 subjects has the place 4,049,955,000; with fewer pairs, Row stays an int."""
    end = ", ".join(f"CAST(NULL AS STRING) AS {f}" for f in linkage.FIELDS)
    rows = spark.sql(f"SELECT named_struct('subject_ord', 89998L, 'uuid', 'a', 'base_id', 'x') AS l, named_struct('subject_ord', 89999L, 'uuid', 'b', 'base_id', 'x') AS r, {end}")
    assert linkage.results(rows, 90_000).first().Row == 90_000 * 89_999 // 2
    assert dict(linkage.results(rows, 65_536).dtypes)["Row"] == "int" and dict(linkage.results(rows, 65_537).dtypes)["Row"] == "bigint"


def test_counted_accuracies(spark):
    """Counted, the accuracies are those of the results; no plan has a row a pair."""
    people = views.subjects(spark, "/root/testdata/sf0.001").where("subject_ord < 60").cache()
    trees = gbt.BoostedTrees().train(gbt.training_counts(people))
    want = linkage_run.accuracies(linkage_run.run(people, linkage_run.Models(trees))).orderBy("model").collect()
    for a, b in zip(linkage_run.counted_accuracies(people, trees).orderBy("model").collect(), want, strict=True):
        assert (a.model, a.pairs) == (b.model, b.pairs) and (a.accuracy, a.recall) == pytest.approx((b.accuracy, b.recall)) and a.pairs == 60 * 59 // 2
    assert "Composite" in want[0].model and want[0].accuracy is None


def test_clustering_makes_few_wedges(spark):
    """Everyone of 60 trades with everyone of 20, all hang on one hub: a wedge a pair at most, where a walk from the lesser end makes 20."""
    edges = [(a, 60 + b, False) for a in range(60) for b in range(20)] + [(n, 80, True) for n in range(80)]
    g = graph(spark, 81, edges)
    rows, _ = g.oriented()
    assert rows.count() == 1280 and rows.join(rows.toDF("v", "w", "far"), "v").count() <= 1280
    got = {r.node_id: r.clustering for r in g.clustering("any").collect()}
    assert got["80"] == pytest.approx(1200 / (80 * 79 / 2)) and got["0"] == pytest.approx(20 / (21 * 20 / 2)) and got["60"] == pytest.approx(60 / (61 * 60 / 2))


def test_propagation_in_blocks(spark):
    """Steps over cells of 13 nodes by 13, with self-loops and a node alone, against dense ones."""
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), rng.random() < 0.5) for _ in range(150)] + [(5, 5, False)]
    g = graph(spark, 62, edges)
    flow = np.zeros((62, 62))
    for a, b, _ in edges:
        flow[b, a] = flow[a, b] = 1
    flow /= np.maximum(flow.sum(0), 1)
    start = np.zeros(62)
    start[[1, 61]] = 1
    trust = start
    for _ in range(4):
        trust = 0.85 * flow @ trust + 0.15 * start
    seeds = spark.createDataFrame([("1",), ("61",)], "node_id string")
    got = {r.node_id: r.trust for r in propagation.ranks(g, seeds, 0.85, 4, 1e-6, True, block=13).collect()}
    assert len(got) == 62 and max(abs(got[str(i)] - trust[i]) for i in range(62)) < 1e-12


def test_paths_meet_in_the_middle(spark, monkeypatch):
    """Paths of up to five hops equal those of a search; of 2,500 that lead away from the ends, none is written."""
    rng = random.Random(5)
    edges = [(rng.randrange(9), rng.randrange(9), rng.random() < 0.5) for _ in range(16)] + [(0, 1, True), (4, 4, False)]
    edges += [(2, 10, False)] + [(10, 11 + i, False) for i in range(50)] + [(11 + i, 61 + j, False) for i in range(50) for j in range(50)]
    near = collections.defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)

    def search(path, most):
        if path[-1] == 1:
            yield tuple(map(str, path))
        elif len(path) < most:
            for n in near[path[-1]] - set(path):
                yield from search([*path, n], most)

    sizes, write = [], graph_module.written
    monkeypatch.setattr(graph_module, "written", lambda df, name: sizes.append((name, (out := write(df, name)).count())) or out)
    for most in (2, 3, 4, 5, 6):
        got = [tuple(r.path) for r in graph(spark, 111, edges).paths("0", "1", most).collect()]
        assert sorted(got) == sorted(search([0], most)) and (most < 3 or got)
    assert max(n for name, n in sizes if name == "paths") < 500


def test_encoder_works_in_slices(spark, monkeypatch):
    """1,201 records of one Arrow batch are never encoded at once, and come out as they do one by one."""
    seen, forward = [], Encoder.forward
    monkeypatch.setattr(Encoder, "forward", lambda self, ids, p=None: seen.append(len(ids)) or forward(self, ids, p))
    kept = []
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: kept.append(f) or (lambda c: F.lit(None)))
    Encoder().encode(views.subjects(spark, "/root/testdata/sf0.001"))
    texts = [f"record {i}" for i in range(1201)]
    out = kept[0](pd.Series(texts))
    assert max(seen) <= 500 and sum(seen) == 1201
    assert np.abs(out[1200] - forward(Encoder(), byte_ids(texts[1200:]))[0][0]).max() < 1e-12


def test_encoder_reads_whole_texts():
    """Texts of any length against attention over all of their bytes; what stands behind the 32nd byte counts."""
    e = Encoder()

    def plain(text):
        raw = list(text.encode("utf-8"))
        x = e.p["emb"][raw + [0] * (32 - len(raw))]
        q, k, v = (x @ e.p[c] for c in "qkv")
        a = np.exp(q @ k.T / 4)
        return (np.maximum((a / a.sum(-1, keepdims=True)) @ v @ e.p["w1"] + e.p["b1"], 0) @ e.p["w2"] + e.p["b2"]).mean(0)

    texts = ["", "été", "x" * 32, "x" * 32 + "y", "record " * 90, "\0b", "".join(map(chr, range(1, 2000)))]
    got = e.forward(byte_ids(texts))[0]
    assert max(np.abs(g - plain(t)).max() for g, t in zip(got, texts)) < 1e-12 and np.abs(got[2] - got[3]).max() > 1e-3
    long = "ab" * 500_000
    assert [len(s) for s in slices([*texts, long, long])] == [7, 2] and np.abs(e.forward(byte_ids([long]))[0] - e.forward(byte_ids(["ab" * 50]))[0]).max() < 1e-9


def test_walks_leave_no_numbered_neighbors(spark, monkeypatch):
    """The numbered neighbours, as large as the graph, are gone when the walks are there."""
    made, number = [], sybil.numbered_neighbors
    monkeypatch.setattr(sybil, "numbered_neighbors", lambda g: made.append(number(g)) or made[0])
    rows = sybil.walks(graph(spark, 4, [(0, 1, False), (1, 2, True)]), spark.createDataFrame([("0",), ("3",)], "node_id string"), 2, 3)
    at = made[0].inputFiles()[0].removeprefix("file://")
    assert rows.count() == 2 * 3 + 2 and not os.path.exists(at)


def test_blocks_make_all_pairs(spark):
    rows = spark.createDataFrame([(i, f"s{i}", f"b{i % 7}", *["v"] * 8) for i in range(50)], "subject_ord long, uuid string, base_id string, " + ", ".join(f"{f} string" for f in linkage.FIELDS))
    got = linkage.pairs(rows, block_rows=9).select(linkage.pair_index(F.lit(50), F.col("l.subject_ord"), F.col("r.subject_ord")).alias("i")).collect()
    assert sorted(r.i for r in got) == list(range(50 * 49 // 2))


def test_coded_pairs_are_the_compared_ones(spark, monkeypatch):
    """By numbers, pairs have the scores, patterns and labels that their values have, also where hashes of different values meet at first."""
    rng = random.Random(4)
    rows = [(i, f"s{i}", f"b{rng.randrange(9)}" if rng.random() < 0.8 else None, *[rng.choice(["a", "A.", "b", "", None]) for _ in linkage.FIELDS]) for i in range(60)]
    people = subjects(spark, rows)
    tried, real = [], F.xxhash64
    monkeypatch.setattr(linkage.F, "xxhash64", lambda *c: tried.append(1) or (real(*c) % 2 if len(tried) == 1 else real(*c)))
    made = linkage.pairs(linkage.coded(people), block_rows=7)
    assert len(tried) > 2
    both = made.select(F.struct(linkage.fs_score(), linkage.pattern(), linkage.label()).alias("want"), F.struct(linkage.fs_score(by_code=True), linkage.pattern(by_code=True), linkage.label(by_code=True)).alias("got")).collect()
    assert len(both) == 60 * 59 // 2 and all(tuple(r.want) == tuple(r.got) for r in both) and len({tuple(r.want) for r in both}) > 100


def test_pairs_move_what_is_asked_for(spark):
    """Only the columns of the answer go through the exchange, and each pair of blocks meets once."""
    people = linkage.coded(views.subjects(spark, "/root/testdata/sf0.001"))
    plan = linkage.pairs(people, block_rows=30).select(F.col("l.uuid").alias("one"), F.col("r.uuid").alias("two"))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_uuid" in plan and not any(f"l_{c}" in plan for c in ("email", "n_email", "c_email", "base_id"))
    blocks = [r.n for r in linkage.pairs(people, block_rows=30).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(blocks) == 150 * 149 // 2 and len(blocks) > 3


def test_scored_pairs_are_not_written(spark, monkeypatch):
    """What the composite and the encoder's query write has no row a pair."""
    sizes = []
    for module in (catalog, composite, linkage):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: sizes.append((out := f(df, name)).count()) or out)
    assert QUERIES["composite_scores"](spark, "/root/testdata/sf0.001").count() == 150 * 149 // 2
    assert sizes and max(sizes) < 5000


def test_trees(spark, tmp_path):
    rng = np.random.default_rng(0)
    counts = [(int(p), int(y), int(n)) for p, y, n in zip(rng.integers(0, 256, 60), rng.integers(0, 2, 60), rng.integers(1, 50, 60))]
    merged = {}
    for p, y, n in counts:
        merged[p, y] = merged.get((p, y), 0) + n
    model = gbt.BoostedTrees().train([(p, y, n) for (p, y), n in sorted(merged.items())])
    single = gbt.BoostedTrees().train([(p, y, 1) for (p, y), n in sorted(merged.items()) for _ in range(n)])
    assert len(model.trees) == 40 and np.allclose(model.probabilities(), single.probabilities(), atol=1e-4)
    model.save(spark, str(tmp_path / "m"))
    assert np.allclose(gbt.BoostedTrees.load(spark, str(tmp_path / "m")).probabilities(), model.probabilities())
    assert set(gbt.BoostedTrees().probabilities()) == {0.5}
    with pytest.raises(ValueError):
        gbt.BoostedTrees().save(spark, str(tmp_path / "x"))


def test_encoder_gradient():
    e = Encoder(1)
    ids = byte_ids(["abc def", "été"])
    d = np.random.default_rng(0).normal(size=(2, 16))
    out, cache = e.forward(ids)
    grads = e.backward(d, cache)
    for k in ("q", "k", "v", "w1", "b2", "emb"):
        at = tuple(ids[0, :1]) + (0,) if k == "emb" else (0,) * e.p[k].ndim
        p = {**e.p, k: e.p[k].copy()}
        p[k][at] += 1e-6
        assert ((e.forward(ids, p)[0] - out) * d).sum() / 1e-6 == pytest.approx(grads[k][at], rel=1e-3, abs=1e-6)
    losses = e.train(["aa", "bb"], ["aa", "zz"], np.array([1, 0]), epochs=30, lr=0.01)
    assert losses[-1] < losses[0]


def test_trust_vectors():
    assert trust.gain(50, trust.influence(trust.VET, 50)) == (58.0, 8.0)
    assert trust.gain(58, 8)[0] == pytest.approx(63.6448)
    assert trust.penalty(50, trust.REPORT, 50)[0] == pytest.approx(35.147786855349885)
    assert trust.penalty(0, trust.REPORT, 100) == (0.0, pytest.approx(149.925056203166))
    assert trust.influence(trust.VET, 30) == 0


def test_accepts_weigh_by_trust():
    for by, want in ((50, 54.0), (70, 58.0), (30, 50.0), (100, 64.0)):
        fold = trust.Fold({"a": by, "b": 50})
        fold.apply("a", "b", "accept")
        assert fold.scores["b"] == pytest.approx(want)


def test_resets_restart_guards_and_counts(spark):
    rng, clock = random.Random(6), [0]
    book = trust.Ledger(now=lambda: clock[0] / 1e6)
    rows = []
    for u in range(6):
        book.add_user(u)
    for seq in range(500):
        clock[0] += rng.choice([1, 120_000_000, 900_000_000])
        a, b = rng.sample(range(6), 2)
        action = rng.choice(["report", "report", "accept", "accept", "vet", "deny", "reset"] if seq % 7 == 0 else ["report", "accept", "vet", "deny"])
        rows.append((seq, clock[0], a, a if action == "reset" else b, action))
        book.reset_user(a) if action == "reset" else getattr(book, action)(a, b)
    frame = spark.createDataFrame(rows, "seq long, ts long, actor long, target long, action string")
    users = spark.range(6).select(F.col("id").alias("username"))
    log = trust.fold(trust.ledger(frame))
    assert {r.username: r.trust_score for r in trust.user_scores(log, users).collect()} == pytest.approx(book.users)
    assert {r.actor for r in trust.spam_flags(frame).collect()} == set(book.spammers)
    got = [(r.username, r.action, r.target, r.weight) for r in trust.newest_first(trust.interaction_log(log)).collect()]
    want = [(u, x[0], str(x[1]), x[3]) for u in range(6) for x in book.log[u]]
    assert sorted(g[:3] for g in got) == sorted(w[:3] for w in want)
    assert sum(g[3] for g in got) == pytest.approx(sum(w[3] for w in want))
    ok, unknown = trust.split_unknown(frame, users.where("username < 4"))
    assert all(max(r.actor, r.target) < 4 for r in ok.collect()) and all(max(r.actor, r.target) >= 4 for r in unknown.collect())
    assert ok.count() + unknown.count() == 500
    book.delete_user(0)
    with pytest.raises(ValueError):
        book.accept(1, 0)
    book.reset_user("nobody")


def test_prompt_ledger_and_batch_agree(spark):
    rng, clock = random.Random(5), [0]
    book = trust.Ledger(now=lambda: clock[0] / 1e6)
    rows = []
    for u in range(8):
        book.add_user(u)
    for seq in range(400):
        clock[0] += rng.choice([1, 120_000_000, 900_000_000])
        a, b = rng.sample(range(8), 2)
        action = rng.choice(["report", "report", "accept", "vet", "deny"])
        rows.append((seq, clock[0], a, b, action))
        getattr(book, action)(a, b)
    frame = spark.createDataFrame(rows, "seq long, ts long, actor long, target long, action string")
    users = spark.range(8).select(F.col("id").alias("username"))
    log = trust.fold(trust.ledger(frame))
    got = {r.username: r.trust_score for r in trust.user_scores(log, users).collect()}
    assert got == pytest.approx(book.users)
    assert {r.actor for r in trust.spam_flags(frame).collect()} == set(book.spammers)
    with pytest.raises(ValueError):
        book.vet(0, 99)


def test_round_trips(spark, tmp_path):
    doc = {"nodes": [{"node_id": "a", "metadata": {"first_name": "Ann", "base_uuid": "x"}}, {"node_id": "b", "metadata": {}}, {"node_id": "a", "metadata": {"first_name": "Zoe"}}], "edges": [{"source": "a", "target": "b", "directed": False, "metadata": {}}]}
    path = str(tmp_path / "g.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    nodes, edges = graph_io.read_graph_json(spark, path)
    assert {r.node_id: json.loads(r.metadata) for r in nodes.collect()} == {"a": {"first_name": "Zoe"}, "b": {}}
    graph_io.write_graph_json(nodes, edges, str(tmp_path / "out"))
    again = graph_io.read_graph_json(spark, str(tmp_path / "out"))
    assert again[0].count() == 2 and again[1].first()["directed"] is False
    with pytest.raises(ValueError):
        graph_io.read_graph_json(spark, str(tmp_path / "none.json"))
    people = graph_io.read_subjects_json(spark, path)
    assert [r.first_name for r in people.orderBy("subject_ord").collect()] == ["Ann", None, "Zoe"]
    users = spark.createDataFrame([("u", 51.5, [("u", "v", "vetted", "t", 0.0)])], "username string, trust_score double, interactions array<struct<actor: string, target: string, action: string, timestamp: string, weight: double>>")
    graph_io.write_trust_state(users, str(tmp_path / "t"))
    assert graph_io.read_trust_state(spark, str(tmp_path / "t")).first()["trust_score"] == 51.5


def test_generator(spark):
    rows = generator.people(spark, 400, 0.3, seed=1).cache()
    found = rows.collect()
    assert len({r.node_id for r in found}) == 400 and 250 < len({r.base_uuid for r in found}) < 340
    assert found == generator.people(spark, 400, 0.3, seed=1).collect()
    made = generator.connections(rows, 100, seed=1).collect()
    assert 50 < len(made) <= 100 and all(r.source != r.target for r in made)
    kin = [r for r in made if r.type == "family"]
    assert kin and all(r.detail.startswith("family_") for r in kin)
    last = {r.node_id: r.last_name for r in found}
    assert all(last[r.source] == last[r.target] for r in kin if r.relationship != "spouse")
    weighed = generator.cluster_connections(rows, F.col("birth_city"), 50, "x", F.lit("y"), 1, F.when(F.col("c") == "Dunmore", 1.0).otherwise(0.0), town=F.col("c"), size=F.col("n"))
    assert {json.loads(r.detail)["town"] for r in weighed.collect()} == {"Dunmore"}
    assert generator.sequences(spark, 10, 5, 1).groupBy("sequence_id").count().where("count <> 5").isEmpty()
    with pytest.raises(ValueError):
        generator.people(spark, 5, 1.5)


def test_name_parts(spark):
    rows = spark.createDataFrame([("Dr. Ada B. Lee, PhD",), ("Mr. Finn",), ("  Gwen   van Harlow III ",), (None,)], "name string")
    first, last = text.first_and_last(F.col("name"))
    assert [tuple(r) for r in rows.select(first, last).collect()] == [("Ada", "Lee,"), (None, None), ("Gwen", "Harlow"), (None, None)]


def test_colors(spark):
    got = spark.createDataFrame([(0, 4), (2, 4), (4, 4), (0, 0)], "v int, m int").select(viz.node_color(F.col("v"), F.col("m")).alias("c"))
    assert [r.c for r in got.collect()] == ["#522de5", "#2de540", "#e52d2d", "#888888"]
    assert "<canvas" in viz.html(graph(spark, 3, [(0, 1, True)]))
    assert (viz.physics(50)["gravitationalConstant"], viz.physics(200)["springLength"], viz.physics(201)["springConstant"]) == (-2000, 200, 0.01)
    assert viz.physics(10)["iterations"] == 100 and viz.physics(120)["iterations"] == 240 and viz.physics(900)["iterations"] == 300
    g = graph(spark, 2, [(0, 1, False)])
    told = Graph(g.nodes.withColumn("metadata", F.lit('{"first_name": "Ann", "age": 3}')), g.edges.withColumn("metadata", F.lit('{"weight": 2.5}')))
    assert {r.title for r in viz.viz_nodes(told).where("node_id = '0'").collect()} == {"0\nconnections: 1\n--- metadata ---\nfirst_name: Ann\nage: 3"}
    assert viz.edge_style(told).first().title == "undirected edge\nfrom: 0\nto: 1\nweight: 2.50"
    with pytest.raises(ValueError):
        viz.html(Graph(g.nodes.limit(0), g.edges))
