"""The trust ledger on a stream of interactions: admission, spam control and scores with keyed state.

State is kept per community, one entry a user or pair: scores, what a user has done to whom since its last reset, its
last reports and accepts, who is ripe for a flag, and who has one. Rows of a micro-batch are taken in order of seq,
so a stream cut at any place gives the batch's ledger, as long as seq grows from batch to batch; rows that come
later than that are not applied, they come out as dead letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinfabric.operators.trust import HOUR, LOG, SPAM_ACCEPTS, SPAM_REPORTS, Fold

LATE = "late"
COLUMNS = ["community", "seq", "part", "ts", "actor", "target", "action", "weight", "score"]


class _Scores(dict):
    """Scores that are read from the state when first asked for, and known to be changed when set."""

    def __init__(self, state):
        super().__init__()
        self.state, self.changed = state, set()

    def get(self, user, default=None):
        if user not in self:
            found = self.state.getValue((user,))
            super().__setitem__(user, found[0] if found else default)
        return self[user]

    def __setitem__(self, user, score):
        super().__setitem__(user, score)
        self.changed.add(user)


class _Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getMapState("scores", "user long", "score double")
        self.done = handle.getMapState("done", "actor long, target long, what string", "epoch long")
        self.epochs = handle.getMapState("epochs", "user long", "epoch long")
        self.recent = handle.getMapState("recent", "user long, what string", "epoch long, ts array<long>")
        self.ripe = handle.getMapState("ripe", "user long", "until long")
        self.flags = handle.getMapState("flags", "user long", "seq long")
        self.last = handle.getValueState("last", "seq long")

    def _admit(self, row) -> bool:
        """Whether a row counts; what it leaves behind for the guards."""
        if row.action == "reset":
            self.epochs.updateValue((row.actor,), (self._epoch(row.actor) + 1,))
            if self.ripe.containsKey((row.actor,)):
                self.ripe.removeKey((row.actor,))
            return True
        epoch = self._epoch(row.actor)
        if row.action != "accept":
            what = "vet" if row.action in ("vet", "deny") else row.action
            if row.action == "report" and self.flags.containsKey((row.actor,)):
                return False
            key = (row.actor, row.target, what)
            seen = self.done.getValue(key)
            if seen and seen[0] == epoch:
                return False
            self.done.updateValue(key, (epoch,))
        if row.action in ("report", "accept"):
            need = SPAM_REPORTS if row.action == "report" else SPAM_ACCEPTS
            held = self.recent.getValue((row.actor, row.action))
            times = [*(held[1] if held and held[0] == epoch else []), row.ts][-need:]
            self.recent.updateValue((row.actor, row.action), (epoch, times))
            if len(times) == need and row.ts < times[0] + HOUR and not self.flags.containsKey((row.actor,)):
                until = self.ripe.getValue((row.actor,))
                self.ripe.updateValue((row.actor,), (max(times[0] + HOUR, until[0] if until else 0),))
        return True

    def _epoch(self, user: int) -> int:
        found = self.epochs.getValue((user,))
        return found[0] if found else 0

    def _tick(self, ts: int, seq: int) -> list[int]:
        """Users that a report attempt at ``ts`` flags; those whose hour is over are ripe no more."""
        found = []
        for (user,), (until,) in list(self.ripe.iterator()):
            self.ripe.removeKey((user,))
            if ts < until:
                self.flags.updateValue((user,), (seq,))
                found.append(user)
        return sorted(found)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seq", "actor"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        fold, out = Fold(_Scores(self.scores)), []

        def apply(actor, target, action):
            return fold.apply(actor, target, action), fold.scores[target]

        for row in frame.itertuples(index=False):
            if last is not None and row.seq <= last:
                out.append((key[0], row.seq, -1, row.ts, row.actor, row.target, LATE, None, None))
                continue
            if row.action == "report":
                for user in self._tick(row.ts, row.seq):
                    out.append((key[0], row.seq, 0, row.ts, user, user, "spam", *apply(user, user, "spam")))
            if self._admit(row):
                out.append((key[0], row.seq, 1, row.ts, row.actor, row.target, row.action, *apply(row.actor, row.target, row.action)))
        if len(frame):
            self.last.update((max(int(frame["seq"].max()), last if last is not None else int(frame["seq"].min())),))
        for user in fold.scores.changed:
            self.scores.updateValue((user,), (fold.scores[user],))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ledger_stream(rows: DataFrame) -> DataFrame:
    """The ledger of ``rows`` (community, seq, ts, actor, target, action), and late rows (action ``late``, part -1).

    ``community`` separates users that never meet; a constant will do. Start the query with :func:`use_keyed_state`.
    """
    rows = rows.select(F.col("community").cast("long").alias("community"), "seq", "ts", "actor", "target", "action")
    return rows.groupBy("community").transformWithStateInPandas(statefulProcessor=_Ledger(), outputStructType=LOG, outputMode="Append", timeMode="None")


def split_late(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger and the dead letters of one micro-batch, as for ``foreachBatch``."""
    return log.where(F.col("action") != LATE), log.where(F.col("action") == LATE).select("community", "seq", "ts", "actor", "target")

