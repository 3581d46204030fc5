"""A trust ledger: relational admission and an ordered fold of scores.

Which interactions count doesn't depend on scores: vet and deny count once per actor and target, reports once
per actor and target until the actor is flagged as a spammer, accepts always. Only the scores need the
order, and they factor by connected component of actors and targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ledger.
INITIAL, MOST, LEAST, EXPONENT = 50.0, 100.0, 0.0, 2
VET, DENY, REPORT, ACCEPT = 8.0, 5.0, 15.0, 4.0
SPAM_REPORTS, SPAM_ACCEPTS, SPAM_PENALTY, MULTIPLIER, HOUR = 5, 30, 20.0, 0.05, 3_600_000_000


def gain(score: float, base: float) -> tuple[float, float]:
    """The new score, and the gain before the cap."""
    share = min(1.0, max(0.0, 1 - (score - INITIAL) / (MOST - INITIAL)))
    g = base * share**EXPONENT
    return min(MOST, score + g), g


def penalty(score: float, amount: float, by: float | None = None) -> tuple[float, float]:
    if by is not None:
        amount *= (max(by, 1e-3) / (max(score, 1e-3) + 1)) ** 0.5
    return max(LEAST, score - amount), amount


def influence(base: float, by: float) -> float:
    return max(0.0, base * (1 + (by - INITIAL) * MULTIPLIER))


def split_unknown(rows: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose actor and target are both in ``users`` (username), and the others: a prompt ledger raises on them, a batch puts them aside."""
    known = users.select(F.col("username").alias("_u")).distinct()
    both = rows.join(known, F.col("actor") == F.col("_u"), "left_semi").join(known, F.col("target") == F.col("_u"), "left_semi")
    return both, rows.join(both.select(F.col("seq").alias("_s")), F.col("seq") == F.col("_s"), "left_anti")


def with_epochs(rows: DataFrame) -> DataFrame:
    """``rows`` with ``epoch``: how often the actor was reset before (action ``reset``, on its own row)."""
    before = Window.partitionBy("actor").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("epoch", F.coalesce(F.count(F.when(F.col("action") == "reset", 1)).over(before), F.lit(0)))


def admitted(rows: DataFrame) -> DataFrame:
    """The interactions that pass the once-only guards, before spam control; an actor's guards restart with each of its resets."""
    group = F.when(F.col("action").isin("vet", "deny"), "vet").otherwise(F.col("action"))
    first = F.row_number().over(Window.partitionBy("actor", "target", group, "epoch").orderBy("seq"))
    return with_epochs(rows).withColumn("_n", first).where(F.col("action").isin("accept", "reset") | (F.col("_n") == 1)).drop("_n")


def spam_flags(rows: DataFrame) -> DataFrame:
    """(actor, flagged_seq): the first report attempt of anyone at which the actor's last hour is spam.

    An actor is ripe from the moment of the 5th report or 30th accept inside an hour, and since its last reset,
    until the first of those is an hour old or it is reset; the flag falls on the first tick after that moment
    and before that end, and stays.
    """
    counted = admitted(rows)
    next_reset = F.min(F.when(F.col("action") == "reset", F.col("seq"))).over(Window.partitionBy("actor").orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    counted = counted.withColumn("over", next_reset).where("action IN ('report', 'accept')")
    by = Window.partitionBy("actor", "action", "epoch").orderBy("seq")
    need = F.when(F.col("action") == "report", SPAM_REPORTS).otherwise(SPAM_ACCEPTS)
    oldest = F.when(F.col("action") == "report", F.lag("ts", SPAM_REPORTS - 1).over(by)).otherwise(F.lag("ts", SPAM_ACCEPTS - 1).over(by))
    ripe = counted.withColumn("end", oldest + HOUR).where("end IS NOT NULL AND ts < end").select("actor", F.col("seq").alias("at"), "end", "over", need.alias("need"))
    # the next tick after each moment: an as-of over ticks and moments together, cut into stretches of seq
    ticks = rows.where("action = 'report'").select("seq", "ts")
    size = rows.agg(F.greatest(F.lit(1), F.ceil((F.max("seq") - F.min("seq") + 1) / 256)).alias("width"), F.min("seq").alias("low"))
    void = F.lit(None).cast("long")
    marked = ticks.select("seq", F.col("ts").alias("tick"), void.alias("actor"), void.alias("end"), void.alias("over"))
    moments = ripe.select(F.col("at").alias("seq"), void.alias("tick"), F.col("actor").cast("long"), F.col("end"), F.col("over").cast("long"))
    both = marked.unionByName(moments).join(F.broadcast(size)).withColumn("part", F.floor((F.col("seq") - F.col("low")) / F.col("width")))
    heads = both.where("tick IS NOT NULL").groupBy("part").agg(F.min(F.struct("seq", "tick")).alias("head"))
    later = F.first("head", True).over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    parts = both.select("part").distinct().join(heads, "part", "left").select("part", later.alias("next"))  # at most 256 rows
    ahead = Window.partitionBy("part").orderBy("seq", F.col("tick").isNull()).rowsBetween(1, Window.unboundedFollowing)
    tick = F.when(F.col("tick").isNotNull(), F.struct("seq", "tick"))
    both = both.withColumn("x", F.first(tick, True).over(ahead)).join(F.broadcast(parts), "part")
    both = both.withColumn("x", F.coalesce("x", "next")).where("end IS NOT NULL AND x IS NOT NULL")
    return both.where("x.tick < end AND (over IS NULL OR x.seq < over)").groupBy("actor").agg(F.min("x.seq").alias("flagged_seq"))


def ledger(rows: DataFrame) -> DataFrame:
    """(seq, part, ts, actor, target, action): admitted interactions, and a spam penalty before the tick that flags."""
    flags = spam_flags(rows)
    ok = admitted(rows).join(flags, "actor", "left")
    ok = ok.where((F.col("action") != "report") | F.col("flagged_seq").isNull() | (F.col("seq") < F.col("flagged_seq")))
    ok = ok.select("seq", F.lit(1).alias("part"), "ts", "actor", "target", "action")
    at = rows.select(F.col("seq").alias("flagged_seq"), "ts")
    fined = flags.join(at, "flagged_seq").select(F.col("flagged_seq").alias("seq"), F.lit(0).alias("part"), "ts", "actor", F.col("actor").alias("target"), F.lit("spam").alias("action"))
    return ok.unionByName(fined)


class Fold:
    """The score recurrence; scores start at INITIAL."""

    def __init__(self, scores: dict | None = None):
        self.scores = scores if scores is not None else {}

    def apply(self, actor, target, action: str) -> float:
        """The weight that the target's log shows."""
        get = self.scores.get
        t, by = get(target, INITIAL), get(actor, INITIAL)
        if action == "vet":
            self.scores[target], w = gain(t, influence(VET, by))
        elif action == "accept":
            self.scores[target], w = gain(t, influence(ACCEPT, by))
        elif action == "deny":
            self.scores[target], w = penalty(t, influence(DENY, by), by)
            w = -w
        elif action == "report":
            self.scores[target], w = penalty(t, REPORT, by)
            w = -w
        elif action == "reset":
            self.scores[target], w = INITIAL, 0.0
        else:
            self.scores[target], w = penalty(t, SPAM_PENALTY)
            w = -w
        return w


LOG = "community long, seq long, part int, ts long, actor long, target long, action string, weight double, score double"


def fold(rows: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """``rows`` of :func:`ledger` with the weight and the target's new score, community by community.

    ``communities`` (username, community) should be connected components; without it all is one.
    """
    if communities is None:
        rows = rows.withColumn("community", F.lit(0).cast("long"))
    else:
        rows = rows.join(communities.toDF("actor", "community"), "actor")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["seq", "part", "actor"], kind="stable")
        state, weights, scores = Fold(), [], []
        for actor, target, action in zip(frame["actor"], frame["target"], frame["action"], strict=True):
            weights.append(state.apply(actor, target, action))
            scores.append(state.scores[target])
        return frame.assign(weight=weights, score=scores)[["community", "seq", "part", "ts", "actor", "target", "action", "weight", "score"]]

    return rows.groupBy("community").applyInPandas(run, LOG)


def user_scores(log: DataFrame, users: DataFrame) -> DataFrame:
    """(username, trust_score) after the log; INITIAL for those it doesn't touch."""
    last = log.groupBy(F.col("target").alias("username")).agg(F.max_by("score", F.struct("seq", "part")).alias("trust_score"))
    return users.join(last, "username", "left").select("username", F.coalesce("trust_score", F.lit(INITIAL)).alias("trust_score"))


def interaction_log(log: DataFrame) -> DataFrame:
    """(username, seq, ts, actor, target, action, weight): one row on each side; a penalty's target is ``system``.

    A reset empties the user's own log: rows up to the last one are left out. :func:`newest_first` puts it in order.
    """
    past = {"vet": ("vetted_by", "vetted"), "deny": ("vet_denied_by", "vet_denied"), "report": ("reported_by", "reported"), "accept": ("accepted_by", "accepted"), "spam": ("spam_detected", None)}
    got = given = F.lit(None).cast("string")
    for action, (theirs, own) in past.items():
        got = F.when(F.col("action") == action, theirs).otherwise(got)
        given = F.when(F.col("action") == action, F.lit(own)).otherwise(given)
    done, spam = log.where("action <> 'reset'"), F.col("action") == "spam"
    name = lambda c: F.col(c).cast("string")
    # as logged: the owner of the log acts, on the other side of the interaction
    a = done.select(F.col("target").alias("username"), "seq", "ts", name("target").alias("actor"), F.when(spam, "system").otherwise(name("actor")).alias("target"), got.alias("action"), "weight")
    b = done.where(~spam).select(F.col("actor").alias("username"), "seq", "ts", name("actor").alias("actor"), name("target").alias("target"), given.alias("action"), F.lit(0.0).alias("weight"))
    last = log.where("action = 'reset'").groupBy(F.col("target").alias("username")).agg(F.max("seq").alias("_reset"))
    return a.unionByName(b).join(last, "username", "left").where("_reset IS NULL OR seq > _reset").drop("_reset")


def newest_first(log: DataFrame) -> DataFrame:
    """Users in order, each user's rows from the last to the first."""
    return log.orderBy("username", F.desc("seq"), F.desc("action"))


class Ledger:
    """A small ledger kept in memory, for sessions at a prompt; batches and streams use the functions above."""

    def __init__(self, now=None):
        self.users: dict[str, float] = {}
        self.log: dict[str, list[tuple]] = {}
        self.spammers: list[str] = []  # stays over resets and deletions
        self.now = now or __import__("time").time

    def add_user(self, name: str) -> None:
        self.users.setdefault(name, INITIAL)
        self.log.setdefault(name, [])

    def get_user(self, name: str) -> float:
        if name not in self.users:
            raise ValueError(f"no such user: {name}")
        return self.users[name]

    def _act(self, by: str, to: str, action: str, done: str, once: tuple[str, ...]) -> bool:
        self.get_user(by), self.get_user(to)
        if once and any(x[0] in once and x[1] == to for x in self.log[by]):
            return False
        w = Fold(self.users).apply(by, to, action)
        self.log[to].append((f"{done}_by", by, self.now(), w))
        self.log[by].append((done, to, self.now(), 0.0))
        return True

    def vet(self, by: str, to: str) -> bool:
        return self._act(by, to, "vet", "vetted", ("vetted", "vet_denied"))

    def deny(self, by: str, to: str) -> bool:
        return self._act(by, to, "deny", "vet_denied", ("vetted", "vet_denied"))

    def report(self, by: str, to: str) -> bool:
        self.get_user(by), self.get_user(to)
        self.detect_spam()
        return by not in self.spammers and self._act(by, to, "report", "reported", ("reported",))

    def accept(self, by: str, to: str) -> None:
        self._act(by, to, "accept", "accepted", ())

    def detect_spam(self) -> list[str]:
        for name in self.users:
            recent = [x[0] for x in self.log[name] if self.now() - x[2] < HOUR / 1e6]
            if name not in self.spammers and (recent.count("reported") >= SPAM_REPORTS or recent.count("accepted") >= SPAM_ACCEPTS):
                w = Fold(self.users).apply(name, name, "spam")
                self.log[name].append(("spam_detected", "system", self.now(), w))
                self.spammers.append(name)
        return self.spammers

    def reset_user(self, name: str) -> None:
        if name in self.users:
            self.users[name], self.log[name] = INITIAL, []

    def reset_all(self) -> None:
        for name in self.users:
            self.reset_user(name)

    def delete_user(self, name: str) -> None:
        self.users.pop(name, None)
        self.log.pop(name, None)

    def delete_all(self) -> None:
        self.users.clear()
        self.log.clear()
