"""Steps of trust over a graph as a matrix cut into cells.

Nodes are dealt to blocks by a hash and numbered inside; a cell has the links from one block to another as two arrays of
numbers. A step meets each cell with the trust of its source block and adds up what reaches the target block, so what moves
are vectors of blocks, not a row a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfabric.operators.graph import Graph
from kinfabric.plans.lineage import discard, written

#: Nodes of a block, links of a cell's row, source blocks of a file, and nodes up to which their trust is broadcast.
BLOCK, MOST_LINKS, BAND, MOST_BROADCAST = 32_768, 1_000_000, 16, 8_000_000
#: Rows of cells that a worker holds at a time.
BATCH = 8
CELLS = "i int, j int, band int, src binary, dst binary"
STATE = "i int, s binary, deg binary, t binary, moved double"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _rows(schema: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(schema)], [name for name, _ in schema])


_CELL = [("i", pa.int32()), ("j", pa.int32()), ("band", pa.int32()), ("src", pa.binary()), ("dst", pa.binary())]
_STATE = [("i", pa.int32()), ("s", pa.binary()), ("deg", pa.binary()), ("t", pa.binary()), ("moved", pa.float64())]


def _packed(batches):
    """Links (bi, pi, bj, pj), both ways, to pieces of cells: one set of pieces for a million links."""

    def out(parts):
        bi, pi, bj, pj = (np.concatenate([p[k] for p in parts]) for k in range(4))
        both = (bi != bj) | (pi != pj)  # a self-loop goes one way
        i, j = np.concatenate([bi, bj[both]]).astype(np.int64), np.concatenate([bj, bi[both]]).astype(np.int64)
        src, dst = np.concatenate([pi, pj[both]]), np.concatenate([pj, pi[both]])
        cell = i << 32 | j
        order = np.argsort(cell, kind="stable")
        cell, src, dst = cell[order], src[order], dst[order]
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        ends = np.append(at[1:], len(cell))
        rows = [(int(cell[a] >> 32), int(cell[a] & 0xFFFFFFFF), int(cell[a] >> 32) // BAND, src[a:b].tobytes(), dst[a:b].tobytes()) for a, b in zip(at, ends, strict=True)]
        for k in range(0, len(rows), 1000):
            yield _rows(_CELL, rows[k : k + 1000])

    parts, held = [], 0
    for b in batches:
        parts.append([b.column(k).to_numpy(zero_copy_only=False).astype(np.int32) for k in range(4)])
        held += b.num_rows
        if held >= MOST_LINKS:
            yield from out(parts)
            parts, held = [], 0
    if held:
        yield from out(parts)


def _merged(batches):
    """Pieces, sorted by cell, to rows of a cell of up to ``MOST_LINKS`` links."""

    def out(key, parts):
        src, dst = (np.concatenate([np.frombuffer(p[k], np.int32) for p in parts]) for k in (0, 1))
        order = np.argsort(dst.astype(np.int64) << 32 | src)
        return _rows(_CELL, [(*key, key[0] // BAND, src[order].tobytes(), dst[order].tobytes())])

    key, parts, held = None, [], 0
    for b in batches:
        for i, j, src, dst in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if parts and ((i, j) != key or held >= MOST_LINKS):
                yield out(key, parts)
                parts, held = [], 0
            key = (i, j)
            parts.append((src, dst))
            held += len(src) // 4
    if parts:
        yield out(key, parts)


def _sent(batches):
    """What each cell (j, src, dst) with the state of its source block (deg, t, size of j) sends, added up by target block."""
    got: dict[int, np.ndarray] = {}
    for b in batches:
        for j, src, dst, deg, t in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            flow = np.frombuffer(t) / np.maximum(np.frombuffer(deg), 1.0)
            sums = np.bincount(np.frombuffer(dst, np.int32), flow[np.frombuffer(src, np.int32)])
            if j not in got or len(got[j]) < len(sums):
                sums, small = sums.copy(), got.get(j)
                if small is not None:
                    sums[: len(small)] += small
                got[j] = sums
            else:
                got[j][: len(sums)] += sums
    for j, sums in got.items():
        yield _rows(_STATE, [(j, None, None, sums.tobytes(), 0.0)])


def _stepped(damping: float):
    def run(batches):
        """The state's rows (with s) and what was sent (without) to the state after the step; ``moved`` is the squared length of it."""
        state, got = {}, {}
        for b in batches:
            for i, s, deg, t in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if s is not None:
                    state[i] = (s, deg, t)
                elif i in got:
                    one, two = sorted((got[i], np.frombuffer(t)), key=len)
                    got[i] = two.copy()
                    got[i][: len(one)] += one
                else:
                    got[i] = np.frombuffer(t)
        for i, (s, deg, t) in state.items():
            old, new = np.frombuffer(t), (1 - damping) * np.frombuffer(s)
            if i in got:
                new[: len(got[i])] += damping * got[i]
            yield _rows(_STATE, [(i, s, deg, new.tobytes(), float(((new - old) ** 2).sum()))])

    return run


def _blocked(batches):
    """Rows (block, pos, s, deg) sorted by them to a state row a block."""
    key, parts = None, []

    def out():
        s, deg = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return _rows(_STATE, [(key, s.tobytes(), deg.tobytes(), s.tobytes(), 0.0)])

    for b in batches:
        block, s, deg = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        at = np.flatnonzero(np.diff(block, prepend=block[0] - 1)) if len(block) else []
        for a, e in zip(at, [*at[1:], len(block)], strict=True):
            if parts and key != int(block[a]):
                yield out()
                parts = []
            key = int(block[a])
            parts.append((s[a:e].astype(np.float64), deg[a:e].astype(np.float64)))
    if parts:
        yield out()


def _told(batches):
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = np.frombuffer(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i, np.int32)), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(t)], ["block", "pos", "trust"])


def _small_batches(run):
    """Rows of cells are large: few of them a batch while ``run`` does."""

    def held(graph: Graph, *args, **options):
        conf = graph.nodes.sparkSession.conf
        before = conf.get(BATCH_KEY)
        try:
            return run(graph, before, *args, **options)
        finally:
            conf.set(BATCH_KEY, before)

    return held


@_small_batches
def ranks(graph: Graph, batch: str, seeds: DataFrame, damping: float, iterations: int, epsilon: float, fixed: bool, block: int = BLOCK) -> DataFrame:
    """(node_id, node_ord, trust), written; see :func:`kinfabric.operators.sybil.propagate`."""
    spark = graph.nodes.sparkSession
    n = graph.nodes.count()
    blocks = max(1, -(-n // block))
    place = F.row_number().over(Window.partitionBy("block").orderBy("node_id")) - 1
    links = graph.neighbors()
    share = links.groupBy("node_id").agg(F.count("*").alias("deg"))
    rows = graph.nodes.select("node_id", "node_ord", F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("pos", place.cast("int"))
    rows = rows.join(share, "node_id", "left").join(seeds.select("node_id", F.lit(1.0).alias("s")), "node_id", "left")
    nodes = written(rows.select("node_id", "node_ord", "block", "pos", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("deg", F.lit(0)).cast("double").alias("deg")), "numbered")
    of = lambda side, b, p: nodes.select(F.col("node_id").alias(side), F.col("block").alias(b), F.col("pos").alias(p))
    one_way = links.where("node_id <= nbr").join(of("node_id", "bi", "pi"), "node_id").select("bi", "pi", "nbr").join(of("nbr", "bj", "pj"), "nbr")
    pieces = one_way.select("bi", "pi", "bj", "pj").mapInArrow(_packed, CELLS).repartition("j", "band").sortWithinPartitions("i", "j")
    cells = written(pieces.mapInArrow(_merged, CELLS), "cells")
    start = nodes.repartition(F.col("block")).sortWithinPartitions("block", "pos").select("block", "pos", "s", "deg")
    state = written(start.mapInArrow(_blocked, STATE), "state")
    spark.conf.set(BATCH_KEY, str(BATCH))
    for _ in range(iterations):
        known = state.select("i", "deg", "t")
        known = F.broadcast(known) if n <= MOST_BROADCAST else known
        sent = cells.join(known, "i").select("j", "src", "dst", "deg", "t").mapInArrow(_sent, STATE)
        new = written(state.unionByName(sent).repartition(F.col("i")).mapInArrow(_stepped(damping), STATE), "state")
        if not fixed and (new.agg(F.sum("moved")).first()[0] or 0.0) ** 0.5 < epsilon:
            discard(new)
            break
        discard(state)
        state = new
    trust = state.select("i", "t").mapInArrow(_told, "block int, pos int, trust double")
    spark.conf.set(BATCH_KEY, batch)
    out = written(nodes.join(trust, ["block", "pos"]).select("node_id", "node_ord", "trust"), "ranks")
    discard(cells, state, nodes)
    return out
