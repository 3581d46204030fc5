"""Nodes, edges, subjects and interactions derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND_STEP = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, node_ord, kind, name): regions, nations, suppliers, customers; node_ord orders by kind and key."""
    parts = []
    for i, (kind, name, key, label) in enumerate(
        [("r", "region", "r_regionkey", "r_name"), ("n", "nation", "n_nationkey", "n_name"), ("s", "supplier", "s_suppkey", "s_name"), ("c", "customer", "c_custkey", "c_name")]
    ):
        k = F.col(key).cast("long")
        parts.append(table(spark, d, name).select(F.concat(F.lit(kind), k.cast("string")).alias("node_id"), (F.lit(i * KIND_STEP) + k).alias("node_ord"), F.lit(name).alias("kind"), F.col(label).alias("name")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, directed, type): location edges, and trade between customers and suppliers, one edge a pair."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def of(df, a, b, directed, kind):
        return df.select(a.alias("source"), b.alias("target"), F.lit(directed).alias("directed"), F.lit(kind).alias("type"))

    trade = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return (
        of(table(spark, d, "nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), True, "located_in")
        .unionByName(of(table(spark, d, "supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), False, "based_in"))
        .unionByName(of(table(spark, d, "customer"), key("c", "c_custkey"), key("n", "c_nationkey"), True, "resident_of"))
        .unionByName(of(trade, key("c", "o_custkey"), key("s", "l_suppkey"), False, "trade"))
    )


def relatives(spark: SparkSession, d: str) -> DataFrame:
    """(node_ord, uuid, last_name, dob): one person a customer, twelve in turn to a surname.

    Three of four surnames span three generations, 38 years apart; the fourth has one.
    """
    k = F.col("c_custkey").cast("long")
    year = 1920 + F.when(F.floor(k / 12) % 4 == 0, 0).otherwise(38 * (k % 3)) + k * 7 % 18
    day = lambda c: F.lpad(c.cast("string"), 2, "0")
    return table(spark, d, "customer").select(
        k.alias("node_ord"),
        F.concat(F.lit("p"), k.cast("string")).alias("uuid"),
        F.concat(F.lit("house"), F.floor(k / 12).cast("string")).alias("last_name"),
        F.concat_ws("-", year.cast("string"), day(1 + k % 12), day(1 + k * 5 % 28)).alias("dob"),
    )


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """One person record a customer; keys 1 and 2 of each four repeat key 0 with perturbations."""
    k = F.col("c_custkey")
    b = F.when((k % 4).isin(1, 2), k - k % 4).otherwise(k)
    rows = table(spark, d, "customer").select(k.alias("k"), b.alias("b"))
    base = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    base = base.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = base.select(F.col("c_custkey").alias("b"), "c_mktsegment", "n_name", "r_name")
    rows = rows.join(base, "b")
    k, b, one = F.col("k"), F.col("b"), F.col("k") % 4 == 1
    segment = F.col("c_mktsegment")
    mail = F.element_at(F.array(*map(F.lit, ("gmail.com", "aol.com", "proton.me"))), (F.when(one, k).otherwise(b) % 3 + 1).cast("int"))
    born = F.date_add(F.lit("1950-01-01").cast("date"), (b * 37 % 20000 + F.when((k % 4 == 2) & (b % 5 == 0), 1).otherwise(0)).cast("int"))
    return rows.select(
        k.alias("subject_ord"),
        F.concat(F.lit("s"), k.cast("string")).alias("uuid"),
        F.concat(F.lit("b"), b.cast("string")).alias("base_id"),
        F.when(one & (b % 3 == 0), F.expr("substring(c_mktsegment, 1, length(c_mktsegment) - 1)")).otherwise(segment).alias("first_name"),
        F.when(b % 10 < 7, F.chr(65 + b % 26)).alias("middle_name"),
        F.col("n_name").alias("last_name"),
        born.cast("string").alias("dob"),
        F.when(b % 17 == 0, F.lit("2010-01-01")).alias("dod"),
        F.concat(F.lower(F.concat(segment, F.lit("."), F.col("n_name"))), F.lit("@"), mail).alias("email"),
        F.when((b % 10 != 9) & (k % 4 != 2), F.concat(F.lit("555"), F.lpad((b * 7919 % 10000000).cast("string"), 7, "0"))).alias("phone_number"),
        F.when(b % 5 != 4, F.col("r_name")).alias("birth_city"),
    )


SPAN_SECONDS = 40_000


def interactions(spark: SparkSession, d: str, span: int = SPAN_SECONDS) -> DataFrame:
    """(seq, ts microseconds, actor, target, action) from events, with a clock compressed into ``span`` seconds."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    size = events.agg((F.max("user_id") + 1).alias("u"), F.count("*").alias("n"))
    action = F.when(F.col("event_type") == "error", "report").when(F.col("event_type") == "purchase", "vet")
    action = action.when(F.col("event_type") == "signup", "deny").otherwise("accept")
    rows = events.join(F.broadcast(size))  # one row
    return rows.select(
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") * F.lit(span * 1000000) / F.col("n")).cast("long").alias("ts"),
        F.col("user_id").alias("actor"),
        ((F.col("user_id") + 1 + F.col("event_id") * 7 % (F.col("u") - 1)) % F.col("u")).alias("target"),
        action.alias("action"),
    )


def interactions_with_resets(spark: SparkSession, d: str, every: int = 50) -> DataFrame:
    """:func:`interactions` with seq doubled, and behind each event whose id is a multiple of ``every`` a reset of its actor."""
    rows = interactions(spark, d).withColumn("seq", F.col("seq") * 2)
    reset = rows.where(F.col("seq") % (2 * every) == 0).select((F.col("seq") + 1).alias("seq"), "ts", "actor", F.col("actor").alias("target"), F.lit("reset").alias("action"))
    return rows.unionByName(reset)
