"""Registered queries of the engine and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfabric.functions.text import decade, email_domain
from kinfabric.operators import composite, gbt, generator, linkage, linkage_run, sybil, trust, viz
from kinfabric.operators.graph import Graph, adjacency, first_wins, top
from kinfabric.operators.transformer import Encoder, similarity, spread
from kinfabric.plans import oracle as sql
from kinfabric.plans.lineage import written
from kinfabric.sources import views
from kinfabric.streaming import activity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph(views.nodes(spark, d).select("node_id", "node_ord", "kind", "name"), views.edges(spark, d))


def r6(c) -> F.Column:
    return F.round(c, 6)


def near6(c) -> F.Column:
    """:func:`r6` without decimal arithmetic, for rows by the thousand million that no SQL is held against; c is 0 or more."""
    return F.floor(c * 1000000 + 0.5) / 1000000.0


# Linkage


@query(sql.FS)
def fs_score(spark, d):
    rows = linkage.pairs(linkage.coded(views.subjects(spark, d)))
    n = views.table(spark, d, "customer").count()
    out = linkage.results(rows, n, fs=linkage.fs_score(by_code=True), by_code=True)
    return out.select("Row", "Subject1_UUID", "Subject2_UUID", "Felligi_Sunter_Similarity_Score", "Match", "Base_ID")


@query(sql.FS_ACCURACY)
def fs_accuracy(spark, d):
    out = linkage.fs_accuracy(views.subjects(spark, d))
    return out.select(r6("accuracy").alias("accuracy"), r6("recall").alias("recall"), "pairs")


@query(sql.AGREEMENTS)
def agreement_counts(spark, d):
    return linkage.agreement_counts(views.subjects(spark, d))


@query(sql.PAIR_LABELS)
def pair_labels(spark, d):
    return linkage.labelled_pairs(views.subjects(spark, d)).select(F.col("l.uuid").alias("one"), F.col("r.uuid").alias("two"), linkage.label().alias("label"))


@query(sql.PATTERNS)
def pattern_counts(spark, d):
    return linkage.pattern_counts(views.subjects(spark, d))


@query(sql.BLOCKED)
def blocked_pairs(spark, d):
    """Pairs that agree on surname and city, and the share of all matches that they hold (the recall of blocking)."""
    subjects = views.subjects(spark, d)
    kept = linkage.pairs(subjects, blocking=["last_name", "birth_city"]).agg(F.count("*").alias("pairs"), F.sum(linkage.label()).alias("found"))
    every = linkage.labelled_pairs(subjects).agg(F.count("*").alias("matches"))
    return kept.join(F.broadcast(every)).select("pairs", r6(F.col("found") / F.col("matches")).alias("recall"))  # one row


def _model(spark, d) -> gbt.BoostedTrees:
    return gbt.BoostedTrees().train(gbt.training_counts(views.subjects(spark, d)))


@query()
def gbt_scores(spark, d):
    rows = written(linkage.pattern_counts(views.subjects(spark, d)), "patterns")
    model = gbt.BoostedTrees().train([tuple(r) for r in rows.orderBy("pattern", "label").collect()])  # at most 512 rows
    return rows.join(F.broadcast(model.table(spark)), "pattern").select("pattern", "label", "n", r6("gbt").alias("gbt"))  # 256 rows


@query(sql.RESULTS)
def linkage_results(spark, d):
    """A run before any training: the trees say 0.5, the encoder and the composite nothing."""
    return linkage_run.run(views.subjects(spark, d), linkage_run.Models(gbt.BoostedTrees()))


@query(sql.ACCURACIES)
def linkage_accuracies(spark, d):
    rows = linkage_run.counted_accuracies(views.subjects(spark, d), gbt.BoostedTrees())
    return rows.select("model", r6("accuracy").alias("accuracy"), r6("recall").alias("recall"), "pairs")


@query()
def transformer_scores(spark, d):
    encoded = written(Encoder().encode(views.subjects(spark, d)).select("subject_ord", "uuid", *linkage.FIELDS, "enc"), "encoded")
    rows = linkage.pairs(spread(encoded))
    return rows.select(F.col("l.uuid").alias("one"), F.col("r.uuid").alias("two"), near6(similarity()).alias("similarity"))


@query()
def composite_scores(spark, d):
    """Pairs are made twice, for the counts that the model is fitted on and for the rows; none is written in between."""
    rows = linkage.pairs(spread(linkage.coded(Encoder().encode(views.subjects(spark, d)))))
    rows = _model(spark, d).score(rows, by_code=True)
    scores = [linkage.floor4(F.col("gbt")).alias("gbt"), linkage.floor4(similarity()).alias("transformer"), linkage.floor4(linkage.fs_score(by_code=True)).alias("fs"), linkage.label(by_code=True).alias("label")]
    model = composite.fit(rows.select(*scores))
    rows = rows.select(F.col("l.uuid").alias("one"), F.col("r.uuid").alias("two"), *scores)
    return composite.score(model, rows).select("one", "two", "gbt", "transformer", "fs", near6(F.col("composite")).alias("composite"), "label")


# Graph store


@query(sql.NODES)
def graph_nodes(spark, d):
    return views.nodes(spark, d)


@query(sql.EDGES)
def graph_edges(spark, d):
    return views.edges(spark, d)


@query(sql.COUNTS)
def graph_counts(spark, d):
    return graph(spark, d).counts()


def _neighbors(direction):
    def run(spark, d):
        return graph(spark, d).neighbors(direction)

    QUERIES[f"neighbors_{direction}"] = run
    ORACLES[f"neighbors_{direction}"] = sql.neighbors(direction)


for _direction in ("all", "outgoing", "incoming", "undirected"):
    _neighbors(_direction)


@query(sql.DEGREE)
def degree(spark, d):
    return graph(spark, d).degrees()


@query(sql.AVG_DEGREE)
def avg_degree(spark, d):
    return graph(spark, d).degrees().agg(r6(F.avg("degree")).alias("avg_degree"))


@query(sql.FIRST_WINS)
def add_edge_firstwins(spark, d):
    """Trade of all customers, added to a graph that has that of the even ones."""
    lines = views.table(spark, d, "lineitem").join(views.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    new = lines.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))
    new = new.agg(F.min(F.struct("l_orderkey", "l_linenumber"))["l_orderkey"].alias("edge_ord")).withColumn("directed", F.lit(False)).withColumn("type", F.lit("order"))
    g = graph(spark, d)
    known = Graph(g.nodes, g.edges.where("type <> 'trade' OR CAST(substring(source, 2) AS BIGINT) % 2 = 0"))
    out = known.add_edges(new, check=False)
    return out.edges.groupBy("type").agg(F.count("*").alias("n"), F.sum("edge_ord").alias("ords"))


@query(sql.CASCADE)
def remove_node_cascade(spark, d):
    g = graph(spark, d)
    out = g.remove_nodes(g.nodes.where("kind = 'nation'"))
    return out.edges.groupBy("type").agg(F.count("*").alias("n"))


@query(sql.DANGLING)
def dangling_edges(spark, d):
    g = graph(spark, d)
    return Graph(g.nodes.where("kind <> 'supplier'"), g.edges).dangling().select("source", "target", "type")


@query(sql.PATHS)
def paths_le4(spark, d):
    return graph(spark, d).paths("n0", "n1", 5).select(F.concat_ws(">", "path").alias("path"))


@query(sql.clustering("ordered"))
def clustering_ordered(spark, d):
    return graph(spark, d).clustering("ordered").select("node_id", r6("clustering").alias("clustering"))


@query(sql.clustering("any"))
def clustering_any(spark, d):
    return graph(spark, d).clustering("any").select("node_id", r6("clustering").alias("clustering"))


@query(sql.COMPONENTS)
def components(spark, d):
    """Of the location edges: one component a region."""
    g = graph(spark, d)
    return Graph(g.nodes, g.edges.where("type <> 'trade'")).components().groupBy("component").agg(F.count("*").alias("n"))


# Sybil detection


@query(sql.SEEDS)
def seeds_degree(spark, d):
    return sybil.select_seeds(graph(spark, d), 10)


@query(sql.SEEDS_RANDOM)
def seeds_random(spark, d):
    return sybil.select_seeds(graph(spark, d), 10, "random")


@query(sql.SEEDS_CLUSTERING)
def seeds_clustering(spark, d):
    return sybil.select_seeds(graph(spark, d), 10, "clustering")


@query(sql.BETWEENNESS)
def betweenness(spark, d):
    return sybil.betweenness(graph(spark, d)).where("betweenness > 0").select("node_id", r6("betweenness").alias("betweenness"))


@query(sql.SEEDS_BETWEENNESS)
def seeds_betweenness(spark, d):
    return sybil.select_seeds(graph(spark, d), 10, "betweenness")


def _stored(spark, d) -> Graph:
    return graph(spark, d).stored()


def _walks(spark, d, length):
    g = _stored(spark, d)
    return g, written(sybil.walks(g, sybil.select_seeds(g, 10), 100, length), "walks")


@query(sql.walks(20, "SELECT * FROM walks"))
def walks_guard(spark, d):
    return _walks(spark, d, 20)[1]


@query(sql.walks(25, "SELECT * FROM walks"))
def walks_limit(spark, d):
    return _walks(spark, d, 25)[1]


@query(sql.walks(20, sql.DIVERSITY))
def guard_diversity(spark, d):
    return sybil.path_diversity(*_walks(spark, d, 20)).select("node_id", r6("diversity").alias("diversity"))


@query(sql.walks(20, sql.ATTACK))
def guard_attack_edges(spark, d):
    return sybil.attack_edges(_walks(spark, d, 20)[1], 0.01).select("source", "target", r6("frequency").alias("frequency"))


@query(sql.walks(20, sql.GUARD))
def guard_scores(spark, d):
    return sybil.guard_scores(*_walks(spark, d, 20)).select("node_id", r6("score").alias("score"))


@query(sql.walks(20, sql.GUARD_SYBILS))
def guard_sybils(spark, d):
    return sybil.guard_sybils(sybil.guard_scores(*_walks(spark, d, 20))).agg(F.count("*").alias("n"))


@query(sql.walks(20, sql.GUARD_TOP))
def guard_top_k(spark, d):
    return top(sybil.guard_scores(*_walks(spark, d, 20)), r6("score"), 10).select("node_id", r6("score").alias("score"))


@query(sql.walks(25, sql.MIXING))
def limit_mixing(spark, d):
    rows = sybil.mixing(_walks(spark, d, 25)[1])
    return rows.select("node_id", "walks_through", "early", "late", r6("mixing_ratio").alias("mixing_ratio"), r6("visit_frequency").alias("visit_frequency"))


@query(sql.walks(25, sql.BALANCE))
def limit_balance(spark, d):
    return sybil.balance(*_walks(spark, d, 25)).select("node_id", r6("balance").alias("balance"))


@query(sql.walks(25, sql.ACCEPTANCE))
def limit_acceptance(spark, d):
    return sybil.acceptance(*_walks(spark, d, 25)).select("node_id", r6("acceptance").alias("acceptance"))


@query(sql.walks(25, sql.AVERAGE))
def limit_average(spark, d):
    return sybil.average_acceptance(sybil.acceptance(*_walks(spark, d, 25))).select(r6("average").alias("average"))


@query(sql.walks(25, sql.LIMIT_SYBILS))
def limit_sybils(spark, d):
    return sybil.limit_sybils(sybil.acceptance(*_walks(spark, d, 25))).agg(F.count("*").alias("n"))


@query(sql.walks(25, sql.TOP_TRUSTED))
def limit_top_trusted(spark, d):
    return top(sybil.acceptance(*_walks(spark, d, 25)), r6("acceptance"), 10).select("node_id", r6("acceptance").alias("acceptance"))


@query(sql.walks(25, sql.TOP_SUSPICIOUS))
def limit_top_suspicious(spark, d):
    return top(sybil.acceptance(*_walks(spark, d, 25)), r6("acceptance"), 10, descending=False).select("node_id", r6("acceptance").alias("acceptance"))


def _ranks(spark, d, **options):
    g = _stored(spark, d)
    return sybil.propagate(g, sybil.select_seeds(g, 10), **options)


@query(sql.rank_after(10, "SELECT node_id, round(trust, 6) AS trust FROM ranks"))
def rank_trust_k10(spark, d):
    """The first ten steps alone."""
    return _ranks(spark, d, iterations=10, fixed=True).select("node_id", r6("trust").alias("trust"))


@query(sql.rank("SELECT node_id, round(trust, 6) AS trust FROM ranks"))
def rank_trust(spark, d):
    return _ranks(spark, d).select("node_id", r6("trust").alias("trust"))


@query(sql.rank("SELECT node_id, round(1 - trust, 6) AS score FROM ranks WHERE 1 - trust >= 1 - 0.1"))
def rank_sybil(spark, d):
    return sybil.rank_sybils(_ranks(spark, d)).select("node_id", r6("score").alias("score"))


@query(sql.rank("SELECT node_id FROM ranks WHERE trust >= 0.1"))
def rank_honest(spark, d):
    return sybil.rank_honest(_ranks(spark, d)).select("node_id")


@query(sql.rank(sql.STATS))
def rank_stats(spark, d):
    rows = sybil.trust_stats(_ranks(spark, d))
    return rows.select(*[r6(c).alias(c) for c in ("mean", "median", "std", "low", "high")], "trusted", "total")


@query(sql.rank("SELECT node_id, round(trust, 6) AS trust FROM ranks JOIN nodes USING (node_id) ORDER BY round(trust, 6) DESC, node_ord LIMIT 10"))
def rank_top_k(spark, d):
    return top(_ranks(spark, d), r6("trust"), 10).select("node_id", r6("trust").alias("trust"))


# Trust ledger


@query(sql.ADMITTED)
def trust_admitted(spark, d):
    return trust.ledger(views.interactions(spark, d)).where("part = 1").select("seq", "actor", "target", "action")


@query(sql.FLAGS)
def trust_spam_flags(spark, d):
    return trust.spam_flags(views.interactions(spark, d))


def _log(spark, d, interactions=views.interactions):
    rows = written(trust.ledger(interactions(spark, d)), "ledger")
    ends = rows.select(F.col("actor").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.lit(False).alias("directed")).distinct()
    ends = written(ends, "ends")
    people = ends.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("node_ord", F.col("node_id").cast("long"))
    labels = Graph(people, ends.where("source <> target")).components()
    return trust.fold(rows, labels.select(F.col("node_id").cast("long"), F.col("component").cast("long")))


def _scores(spark, d, log):
    users = views.table(spark, d, "events").select(F.col("user_id").alias("username")).distinct()
    return trust.user_scores(log, users).select("username", F.round("trust_score", 6).alias("trust_score"))


@query(sql.trust("scores"))
def trust_scores(spark, d):
    return _scores(spark, d, _log(spark, d))


@query(sql.trust("log"))
def trust_log(spark, d):
    return trust.interaction_log(_log(spark, d)).select("username", "seq", "actor", "target", "action", r6("weight").alias("weight"))


@query(sql.trust("scores", resets=True))
def trust_after_reset(spark, d):
    return _scores(spark, d, _log(spark, d, views.interactions_with_resets))


@query(sql.trust("log", resets=True))
def trust_log_after_reset(spark, d):
    log = trust.interaction_log(_log(spark, d, views.interactions_with_resets))
    return log.select("username", "seq", "actor", "target", "action", r6("weight").alias("weight"))


@query(sql.trust("flags", resets=True))
def trust_flags_after_reset(spark, d):
    return trust.spam_flags(views.interactions_with_resets(spark, d))


# Clusters, families, connections


@query(sql.CITY)
def city_clusters(spark, d):
    return views.subjects(spark, d).groupBy(F.coalesce("birth_city", F.lit("unknown")).alias("city")).agg(F.count("*").alias("n"))


@query(sql.AGE)
def age_clusters(spark, d):
    return views.subjects(spark, d).groupBy(decade(F.col("dob")).alias("decade")).agg(F.count("*").alias("n"))


@query(sql.EMAIL)
def email_clusters(spark, d):
    return views.subjects(spark, d).groupBy(email_domain(F.col("email")).alias("domain")).agg(F.count("*").alias("n"))


@query(sql.GENERATIONS)
def family_generations(spark, d):
    return generator.generations(views.relatives(spark, d)).select("uuid", "last_name", "generation")


@query(sql.FAMILIES)
def families(spark, d):
    return generator.families(views.relatives(spark, d)).select("uuid", "family_id", "generation")


@query(sql.PARENT_CHILD)
def parent_child(spark, d):
    return generator.parent_child(generator.families(views.relatives(spark, d)))


@query(sql.SIBLINGS)
def siblings(spark, d):
    return generator.siblings(generator.families(views.relatives(spark, d)))


@query(sql.SPOUSES)
def spouses(spark, d):
    people = views.relatives(spark, d)
    return generator.spouses(people, generator.families(people))


@query(sql.DEDUP)
def dedup_connections(spark, d):
    lines = views.table(spark, d, "lineitem").select(F.concat(F.lit("p"), (F.col("l_partkey") % 1000).cast("string")).alias("source"), F.concat(F.lit("p"), (F.col("l_suppkey") % 1000).cast("string")).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_ord"))
    return generator.dedup_connections(lines).select("source", "target", "edge_ord")


def _people(spark, d):
    """As many as customers."""
    return generator.people(spark, views.table(spark, d, "customer").count(), seed=7)


@query(sql.PEOPLE)
def generated_people(spark, d):
    return _people(spark, d)


@query(sql.CONNECTIONS)
def generated_connections(spark, d):
    people = written(_people(spark, d), "people")
    return generator.connections(people, people.count(), seed=7).select("source", "target", "directed", "type", "relationship", "detail")


@query(sql.SUMMARY)
def generated_summary(spark, d):
    return generator.summary(generated_connections(spark, d))


@query(sql.SEQUENCES)
def generated_sequences(spark, d):
    return generator.sequences(spark, views.table(spark, d, "customer").count(), 5, seed=7)


# Presentation, streams


@query(sql.VIZ_NODES)
def viz_nodes(spark, d):
    return viz.viz_nodes(graph(spark, d)).select("node_id", "degree", r6("size").alias("size"), r6("font_size").alias("font_size"))


@query(sql.VIZ_COLORS)
def viz_colors(spark, d):
    return viz.viz_nodes(graph(spark, d)).select("node_id", "color")


@query(sql.VIZ_EDGES)
def viz_edges(spark, d):
    return viz.viz_edges(graph(spark, d))


@query(sql.VIZ_STYLE)
def viz_edge_style(spark, d):
    return viz.edge_style(graph(spark, d)).select("source", "target", "directed", "width", "color", "dashes", "title")


@query(sql.HIGHLIGHT)
def highlight(spark, d):
    return viz.highlight(graph(spark, d), "n0")


@query(sql.HOURLY)
def activity_windows(spark, d):
    return activity.windows(views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")


@query(sql.SESSIONS)
def activity_sessions(spark, d):
    return activity.sessions(views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes").select("user_id", "n", r6("value").alias("value"))
