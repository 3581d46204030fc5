"""Command line: generate a graph document, run a detector or a record linkage on one, draw it; act on a trust ledger.

    python -m kinfabric generate PEOPLE EDGES [-o OUT] [-d LIKELIHOOD] [-s] [--steps N] [--seed N]
    python -m kinfabric guard|limit|rank DATASET.json [--seeds K] [--method M] [--threshold T] [--top-k K]
    python -m kinfabric train DATASET.json MODELS [--epochs N] [--max-samples N]
    python -m kinfabric link DATASET.json MODELS RESULTS [--threshold T] [--scorer NAME ...]
    python -m kinfabric show DATASET.json [-o PAGE.html] [-t TITLE]
    python -m kinfabric trust STATE.json ACTION [USER] [TARGET]   (add, vet, deny, accept, report, reset, reset-all, delete, delete-all, show, spam)
"""

from __future__ import annotations

import argparse
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfabric.operators import generator, linkage_run, sybil, viz
from kinfabric.operators.graph import Graph, top
from kinfabric.operators.trust import Ledger
from kinfabric.plans.lineage import written
from kinfabric.session import session
from kinfabric.sources.graph_io import read_subjects_json, write_graph_json, write_results

#: Where the detail of a connection goes, by its type.
DETAILS = {"family": "family_id", "geographic": "city", "age_cohort": "decade", "workplace": "domain"}
METHODS = {"guard": ("degree", "random"), "limit": ("degree", "random", "betweenness"), "rank": ("degree", "random", "clustering")}


def generate(spark: SparkSession, people: int, edges: int, out: str, duplicates: float = 0.1, sequences: bool = False, steps: int = 5, seed: int = 0) -> None:
    """Write a graph document, properties without a value left out; with ``sequences`` its nodes are identity sequences and it has no edges."""
    if people < 0 or edges < 0:
        raise ValueError("numbers of people and edges can't be negative")
    if not sequences and edges > people * (people - 1) // 2:
        raise ValueError(f"{people} people have at most {people * (people - 1) // 2} pairs")
    if sequences:
        nodes = written(generator.sequences(spark, people, steps, seed), "sequences")
        links = spark.createDataFrame([], "source string, target string, directed boolean, metadata string")
    else:
        nodes = written(generator.people(spark, people, duplicates, seed), "people")
        links = generator.connections(nodes, edges, seed)
        named = [F.when(F.col("type") == kind, F.col("detail")).alias(name) for kind, name in DETAILS.items()]
        links = links.withColumn("metadata", F.to_json(F.struct("type", "relationship", *named)))
    about = [c for c in nodes.columns if c not in ("node_id", "node_ord")]
    write_graph_json(nodes.withColumn("metadata", F.to_json(F.struct(*about))), links, out)


def detect(spark: SparkSession, kind: str, path: str, seeds: int = 10, method: str = "degree", threshold: float | None = None, k: int = 10, **options) -> tuple[sybil.Detection, DataFrame]:
    """What the detector finds, and its ``k`` most suspicious nodes."""
    if method not in METHODS[kind]:
        raise ValueError(f"{kind} chooses seeds by {', '.join(METHODS[kind])}")
    run = {"guard": sybil.detect_guard, "limit": sybil.detect_limit, "rank": sybil.detect_rank}[kind]
    graph = Graph.from_json(spark, path)
    found = run(graph, seeds, method, threshold=threshold, **options)
    score = "acceptance" if kind == "limit" else "score"
    worst = top(found.scores, score, k, descending=kind != "limit")
    return found, sybil.with_names(worst, graph.nodes).orderBy(F.col(score).asc() if kind == "limit" else F.col(score).desc(), "node_ord").select("node_id", "name", score)


def train(spark: SparkSession, path: str, models: str, epochs: int = 10, max_samples: int = 10_000) -> None:
    linkage_run.train(written(read_subjects_json(spark, path), "subjects"), epochs, max_samples).save(spark, models)


def link(spark: SparkSession, path: str, models: str, out: str, threshold: float = 0.9, scorers: list[str] | None = None) -> DataFrame:
    """Score every pair of a document's records, write the results as CSV, return the accuracy of each score."""
    rows = linkage_run.run(written(read_subjects_json(spark, path), "subjects"), linkage_run.Models.load(spark, models), scorers or [])
    rows = written(rows, "results")
    write_results(rows, out)
    return linkage_run.accuracies(rows, threshold)


def read_ledger(path: str) -> Ledger:
    """A ledger from its state document; a missing one is empty. Spammers are found anew, as the state doesn't name them."""
    book = Ledger()
    if os.path.exists(path):
        with open(path) as f:
            state = json.load(f)
        for name, user in state["users"].items():
            book.add_user(name)
            book.users[name] = user["trust_score"]
            book.log[name] = [(i["action"], i["target"], datetime.fromisoformat(i["timestamp"]).replace(tzinfo=UTC).timestamp(), i["weight"]) for i in user["interactions"]]
        book.spammers = [name for name, log in book.log.items() if any(x[0] == "spam_detected" for x in log)]
    return book


def write_ledger(book: Ledger, path: str) -> None:
    said = lambda t: datetime.fromtimestamp(t, UTC).replace(tzinfo=None).isoformat()
    users = {
        name: {"trust_score": score, "interactions": [{"actor": name, "target": to, "action": action, "timestamp": said(t), "weight": w} for action, to, t, w in book.log[name]]}
        for name, score in book.users.items()
    }
    with open(path, "w") as f:
        json.dump({"users": users}, f, indent=2)


def trust(path: str, action: str, user: str | None = None, target: str | None = None) -> list[str]:
    """One action on the ledger in ``path``; the lines to print."""
    book = read_ledger(path)
    acts = {"vet": book.vet, "deny": book.deny, "accept": book.accept, "report": book.report}
    if action in acts:
        done = acts[action](user, target)
        said = [f"{user} {action} {target}: {'refused' if done is False else 'done'}"]
    elif action in ("add", "reset", "delete"):
        {"add": book.add_user, "reset": book.reset_user, "delete": book.delete_user}[action](user)
        said = [f"{action} {user}: done"]
    elif action in ("reset-all", "delete-all"):
        (book.reset_all if action == "reset-all" else book.delete_all)()
        said = [f"{action}: done"]
    elif action == "spam":
        said = book.detect_spam() or ["no spam reporters"]
    elif action == "show":
        said = []
        for name in [user] if user else book.users:
            said.append(f"{name}: {book.get_user(name)}")
            said += [f"  {datetime.fromtimestamp(t, UTC).isoformat()} {done} {to} ({w:+g})" for done, to, t, w in reversed(book.log[name])]
    else:
        raise ValueError(f"no such action: {action}")
    if action != "show":
        write_ledger(book, path)
    return said


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinfabric")
    kinds = parser.add_subparsers(dest="kind", required=True)
    made = kinds.add_parser("generate")
    made.add_argument("people", type=int)
    made.add_argument("edges", type=int)
    made.add_argument("-o", "--output", default="dataset.json")
    made.add_argument("-d", "--duplicates", type=float, default=0.1)
    made.add_argument("-s", "--sequences", action="store_true")
    made.add_argument("--steps", type=int, default=5)
    made.add_argument("--seed", type=int, default=0)
    for kind, methods in METHODS.items():
        one = kinds.add_parser(kind)
        one.add_argument("dataset")
        one.add_argument("--seeds", type=int, default=10)
        one.add_argument("--method", choices=methods, default="degree")
        one.add_argument("--threshold", type=float)
        one.add_argument("--top-k", type=int, default=10)
        if kind == "rank":
            one.add_argument("--damping", type=float, default=0.85)
            one.add_argument("--trust-threshold", type=float, dest="threshold")
    one = kinds.add_parser("train")
    one.add_argument("dataset")
    one.add_argument("models")
    one.add_argument("--epochs", type=int, default=10)
    one.add_argument("--max-samples", type=int, default=10_000)
    one = kinds.add_parser("link")
    one.add_argument("dataset")
    one.add_argument("models")
    one.add_argument("results")
    one.add_argument("--threshold", type=float, default=0.9)
    one.add_argument("--scorer", action="append", default=[])
    one = kinds.add_parser("show")
    one.add_argument("dataset")
    one.add_argument("-o", "--output", default="graph.html")
    one.add_argument("-t", "--title", default="graph")
    one = kinds.add_parser("trust")
    one.add_argument("state")
    one.add_argument("action")
    one.add_argument("user", nargs="?")
    one.add_argument("target", nargs="?")
    args = parser.parse_args(argv)
    if args.kind == "trust":
        print("\n".join(trust(args.state, args.action, args.user, args.target)))
        return
    spark = session()
    if args.kind == "train":
        train(spark, args.dataset, args.models, args.epochs, args.max_samples)
        return
    if args.kind == "link":
        link(spark, args.dataset, args.models, args.results, args.threshold, args.scorer).show(truncate=False)
        return
    if args.kind == "show":
        with open(args.output, "w") as f:
            f.write(viz.html_of_file(spark, args.dataset, title=args.title))
        return
    if args.kind == "generate":
        generate(spark, args.people, args.edges, args.output, args.duplicates, args.sequences, args.steps, args.seed)
        return
    options = {"damping": args.damping} if args.kind == "rank" else {}
    found, worst = detect(spark, args.kind, args.dataset, args.seeds, args.method, args.threshold, args.top_k, **options)
    found.ratio().show()
    if "average" in found.more:
        found.more["average"].show()
    if args.kind == "rank":
        sybil.with_names(top(found.more["ranks"], "trust", args.top_k), found.more["nodes"]).orderBy(F.desc("trust"), "node_ord").show(truncate=False)
    worst.show(args.top_k, truncate=False)


if __name__ == "__main__":
    main()
