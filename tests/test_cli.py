"""The command line, and the filters of the presentation."""

import json

import pytest
from pyspark.sql import functions as F

from kinfabric import __main__ as cli
from kinfabric.operators import viz
from kinfabric.operators.graph import Graph
from kinfabric.sources.graph_io import read_graph_json


def test_generate_and_detect(spark, tmp_path, capsys):
    path = str(tmp_path / "people.json")
    cli.generate(spark, 60, 80, path, 0.3, seed=3)
    nodes, edges = read_graph_json(spark, path)
    assert nodes.count() == 60 and 0 < edges.count() <= 80
    people = [json.loads(r.metadata) for r in nodes.collect()]
    assert all({"first_name", "last_name", "base_uuid"} <= set(x) for x in people) and None not in people[0].values()
    found = [json.loads(r.metadata) for r in edges.collect()]
    assert all({"type", "relationship"} <= set(x) for x in found)
    assert all(set(x) - {"type", "relationship"} <= {cli.DETAILS.get(x["type"])} for x in found)
    for kind in cli.METHODS:
        seen, worst = cli.detect(spark, kind, path, seeds=3, k=5)
        assert worst.count() == 5 and seen.ratio().first()["total"] == 60
        assert all(len(r["name"].split()) >= 2 for r in worst.collect())
    with pytest.raises(ValueError):
        cli.detect(spark, "guard", path, method="betweenness")
    with pytest.raises(ValueError):
        cli.generate(spark, 4, 7, path)
    cli.train(spark, path, str(tmp_path / "models"), epochs=1, max_samples=50)
    table = cli.link(spark, path, str(tmp_path / "models"), str(tmp_path / "out"))
    assert table.count() == 4 and spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 60 * 59 // 2
    assert "<canvas" in viz.html_of_file(spark, path, title="a < b")


def test_trust_commands(tmp_path):
    path = str(tmp_path / "state.json")
    act = lambda *a: cli.trust(path, *a)
    for name in "abcdefg":
        act("add", name)
    assert act("vet", "a", "b") == ["a vet b: done"] and act("vet", "a", "b") == ["a vet b: refused"]
    assert act("show", "b")[0] == "b: 58.0" and "vetted_by a (+8)" in act("show", "b")[1]
    for name in "bcdef":
        assert act("report", "a", name) == [f"a report {name}: done"]
    assert act("report", "a", "g") == ["a report g: refused"] and act("spam") == ["a"]
    assert act("show", "a")[0] == "a: 30.0"
    act("reset", "a")
    assert act("show", "a") == ["a: 50.0"]
    act("delete", "g")
    with pytest.raises(ValueError):
        act("accept", "a", "g")
    with pytest.raises(ValueError):
        act("dance")
    act("delete-all")
    assert json.load(open(path)) == {"users": {}}


def test_sequences(spark, tmp_path):
    path = str(tmp_path / "seq.json")
    cli.generate(spark, 4, 0, path, sequences=True, steps=3)
    nodes, edges = read_graph_json(spark, path)
    assert nodes.count() == 12 and edges.count() == 0
    assert {json.loads(r.metadata)["sequence_step"] for r in nodes.collect()} == {0, 1, 2}


def test_filtered(spark):
    nodes = spark.range(4).select(F.col("id").cast("string").alias("node_id"), F.col("id").alias("node_ord"), F.when(F.col("id") < 2, "x").otherwise("y").alias("kind"))
    edges = spark.createDataFrame([("0", "1", True, "a"), ("1", "2", True, "b"), ("2", "3", False, "b")], "source string, target string, directed boolean, type string")
    picked, kept = viz.filtered(Graph(nodes, edges), "kind", ["x"])
    assert {r.node_id for r in picked.collect()} == {"0", "1"} and [r.type for r in kept.collect()] == ["a"]
    picked, kept = viz.filtered(Graph(nodes, edges), "type", ["b"])
    assert {r.node_id for r in picked.collect()} == {"1", "2", "3"} and kept.count() == 2
    with pytest.raises(ValueError):
        viz.filtered(Graph(nodes, edges), "none", [1])
