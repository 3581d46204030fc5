"""Streams against their batch twins."""

import random
import time

from pyspark.sql import functions as F

from kinfabric.operators import trust
from kinfabric.streaming import activity
from kinfabric.streaming.ledger import ledger_stream, split_late, use_keyed_state

D = "/root/testdata/sf0.001"


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_ledger_stream(spark, tmp_path):
    """Admission, flags, resets and scores on a stream in three parts, with one part that comes too late."""
    rng, clock, made = random.Random(12), 0, []
    for seq in range(300):
        clock += rng.choice([1, 1, 5_000_000, 5_000_000, 20_000_000, 20_000_000, 20_000_000, 600_000_000])
        a = rng.choice([0, 0, 0, 1, 1, *range(12)])
        b = rng.choice([u for u in range(12) if u != a])
        action = rng.choice(["report", "report", "accept", "vet", "deny"] + ["reset"] * (seq % 9 == 0))
        made.append((0, seq, clock, a, a if action == "reset" else b, action))
    rows = spark.createDataFrame(made, "community long, seq long, ts long, actor long, target long, action string")
    for low, high in ((0, 120), (120, 125), (125, 400)):
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of time
    rows.where("seq = 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = trust.fold(trust.ledger(rows.drop("community"))).collect()
    assert any(r.action == "spam" for r in batch)
    use_keyed_state(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(ledger_stream(stream), tmp_path, "ledger_out")
    done, late = split_late(spark.table("ledger_out"))
    key = lambda r: (r.seq, r.part, r.actor, r.target, r.action, round(r.weight, 9), round(r.score, 9))
    assert sorted(map(key, done.collect())) == sorted(map(key, batch))
    assert [r.seq for r in late.collect()] == [30]


def test_sessions_and_unique_events_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.union(events.where("event_id % 3 = 0")).write.parquet(str(tmp_path / "ev"))
    stream = activity.late_split(activity.read_events(spark, str(tmp_path / "ev"), events.schema), "400 days")
    run(activity.unique_events(stream).select("event_id"), tmp_path, "unique_out")
    assert spark.table("unique_out").count() == spark.table("unique_out").distinct().count() == events.count()
    stream = activity.late_split(activity.read_events(spark, str(tmp_path / "ev"), events.schema))
    run(activity.sessions(stream), tmp_path, "session_out")
    batch = {(r.user_id, r.session.start): r.n for r in activity.sessions(events.union(events.where("event_id % 3 = 0"))).collect()}
    got = {(r.user_id, r.session.start): r.n for r in spark.table("session_out").collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    stream = activity.late_split(activity.read_events(spark, str(tmp_path / "ev"), events.schema))
    run(activity.windows(stream, "2 days", "1 day"), tmp_path, "slide_out")
    batch = {(r.start, r.event_type): r.n for r in activity.windows(events.union(events.where("event_id % 3 = 0")), "2 days", "1 day").collect()}
    got = {(r.start, r.event_type): r.n for r in spark.table("slide_out").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_activity_stream(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = activity.read_events(spark, str(tmp_path / "ev"), events.schema)
    out = activity.windows(activity.late_split(stream), "1 day")
    run(out, tmp_path, "act_out")
    batch = {(r.start, r.event_type): r.n for r in activity.windows(events, "1 day").collect()}
    got = {(r.start, r.event_type): r.n for r in spark.table("act_out").collect()}
    assert got and all(batch[k] == n for k, n in got.items())
