"""Graph documents, Parquet graphs, result CSV and trust-state JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "nodes array<struct<node_id: string, metadata: variant>>, edges array<struct<source: string, target: string, directed: boolean, metadata: variant>>"
RESULT = (
    "Row int, Subject1_UUID string, Subject2_UUID string, Gradient_Boosted_Score double, Transformer_Similarity_Score double, "
    "Felligi_Sunter_Similarity_Score double, Composite_Score double, Match string, Base_ID string"
)
STATE = "users map<string, struct<trust_score: double, interactions: array<struct<actor: string, target: string, action: string, timestamp: string, weight: double>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document; of repeated ids or keys the last wins; endpoints are not checked."""
    if not exists(spark, path):
        raise ValueError(f"no such graph document: {path}")
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    nodes = doc.select(F.posexplode("nodes").alias("node_ord", "x")).select("x.node_id", F.col("node_ord").cast("long"), F.to_json("x.metadata").alias("metadata"))
    edges = doc.select(F.posexplode("edges").alias("edge_ord", "x"))
    edges = edges.select("x.source", "x.target", F.coalesce("x.directed", F.lit(True)).alias("directed"), F.col("edge_ord").cast("long"), F.to_json("x.metadata").alias("metadata"))
    last = lambda df, keys, ord_: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ord_)))).where("_n = 1").drop("_n")
    return last(nodes, ["node_id"], "node_ord"), last(edges, ["source", "target"], "edge_ord")


#: Nodes and edges that one JSON document may hold.
MOST_IN_DOCUMENT = 1_000_000


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, most: int = MOST_IN_DOCUMENT) -> None:
    """One document, as the format asks, so of at most ``most`` nodes and edges; larger graphs go to :func:`write_graph`."""
    if nodes.limit(most + 1).count() + edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes and edges for one document; write_graph writes Parquet")
    meta = lambda df: F.parse_json("metadata") if "metadata" in df.columns else F.parse_json(F.lit("{}"))
    order = "node_ord" if "node_ord" in nodes.columns else "node_id"
    n = nodes.select(F.struct(F.col(order).alias("_o"), F.struct("node_id", meta(nodes).alias("metadata")).alias("x")).alias("s"))
    e = edges.select(F.struct("source", "target", "directed", meta(edges).alias("metadata")).alias("x"))
    listed = n.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("s._o"), F.to_json("s.x").alias("j")))).alias("n"))
    other = e.groupBy().agg(F.sort_array(F.collect_list(F.to_json("x"))).alias("e"))
    text = F.concat(F.lit('{"nodes": ['), F.concat_ws(", ", F.col("n.j")), F.lit('], "edges": ['), F.concat_ws(", ", "e"), F.lit("]}"))
    listed.crossJoin(other).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)  # one row each


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_subjects_json(spark: SparkSession, path: str) -> DataFrame:
    """Person records of a document's nodes, wrapped in metadata or flat; the path must end in .json."""
    if not path.endswith(".json"):
        raise ValueError("records are read from .json files")
    doc = spark.read.schema("nodes array<variant>").json(path, multiLine=True)
    rows = doc.select(F.posexplode("nodes").alias("subject_ord", "v"))

    def field(name):
        return F.expr(f"coalesce(try_variant_get(v, '$.metadata.{name}', 'string'), try_variant_get(v, '$.{name}', 'string'))")

    names = {"base_id": "base_uuid", "first_name": "first_name", "middle_name": "middle_name", "last_name": "last_name", "dob": "date_of_birth", "dod": "date_of_death", "email": "email", "phone_number": "phone_number", "birth_city": "birth_city"}
    return rows.select(F.col("subject_ord").cast("long"), F.expr("try_variant_get(v, '$.node_id', 'string')").alias("uuid"), *[field(v).alias(k) for k, v in names.items()])


def write_results(rows: DataFrame, path: str) -> None:
    rows.orderBy("Row").write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(RESULT).csv(path)


def write_trust_state(users: DataFrame, path: str) -> None:
    """``users``: username, trust_score, interactions. Flags of spammers are not part of the state.

    One document, so for at most ``MOST_IN_DOCUMENT`` users; larger ledgers are Parquet tables.
    """
    if users.limit(MOST_IN_DOCUMENT + 1).count() > MOST_IN_DOCUMENT:
        raise ValueError(f"more than {MOST_IN_DOCUMENT} users for one document; write a Parquet table")
    entries = users.select(F.struct("username", F.struct("trust_score", "interactions").alias("v")).alias("e"))
    entries.groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("users")).coalesce(1).write.mode("overwrite").json(path)


def read_trust_state(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(STATE).json(path, multiLine=True)
    return doc.select(F.explode("users").alias("username", "v")).select("username", "v.trust_score", "v.interactions")
