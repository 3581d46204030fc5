"""Suffix-array dedup of byte strings over a whole corpus.

A string of ``LENGTH`` bytes is judged where it meets its equals: at its minimizer, the smallest hash of
its ``MARK``-byte strings, the leftmost of equals. Consecutive strings of a document with their minimizer at
the same place form one stretch, so equal strings always lie in different stretches with one minimizer, at
one distance from it.

Stretches with the same bytes (128-bit hash) are one stretch with a count before anything is sorted; in a
suffix array they would stand side by side with common prefixes of LENGTH bytes or more, so all strings of one
that occurs twice repeat. The different stretches of a minimizer, one copy of each, go into a suffix array
(two-stage sorting), whose adjacent common prefixes of LENGTH bytes or more show the strings that repeat.

A minimizer with more stretches than one array should hold (``ARRAY_ROWS``) is dealt out further, by content:
its stretches are cut by distance from the minimizer into pieces of ``SPREADS[0]`` strings, pieces meet where the
bytes that all strings of the piece share agree, equal pieces become one with a count, and the rest is sorted as
above or cut again, down to single strings. Equal strings stay together at each level, so the results don't
depend on these sizes, and no group is collected into one task.

Only hashes of all stretches are shuffled; bytes move for minimizers of several stretches alone.

Defined cases: null and empty texts have no bytes; texts under LENGTH bytes lose nothing; texts of any length
are read in chunks of 1 MiB that overlap, without loss at the seams; rows that repeat are occurrences of their
own; null ids are reported as they are; matches never cross rows; only doc_id and text are read, so other
columns don't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfabric.llm.hashing import CHUNK, U64, byte_windows, cover, runs, sliding_min
from kinfabric.llm.shared import discard, documents, materialize, row_key, small_batches
from kinfabric.llm.suffix_array import repeated_starts

LENGTH, MARK = 200, 48
#: Stretches of one group in a suffix array at most, and bytes after which no more groups join an array.
ARRAY_ROWS, ARRAY_BYTES = 500, 1 << 17
#: Strings of a piece, level by level, where a group is too large for one array.
SPREADS = (32, 8, 2, 1)
#: The lower bits hold a place in a chunk.
_UPPER = U64(2**64 - 2 * CHUNK)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row_key(F.col("doc_id"), text).alias("rk"))


def _stretches(data: bytes):
    """start, number of strings, minimizer of the stretches of one text, chunk by chunk."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(whole) - LENGTH + 1), CHUNK):
        buf = whole[at : at + CHUNK + LENGTH - 1]
        if len(buf) < LENGTH:
            return
        marks = byte_windows(buf, MARK)
        # the hash's upper bits, then the place: the minimum is the leftmost place of the smallest hash
        low = sliding_min(marks & _UPPER | np.arange(len(marks), dtype=U64), LENGTH - MARK + 1)
        cut = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        count = np.diff(np.concatenate((cut, [len(low)])))
        yield cut + at, count, marks[(low[cut] & ~_UPPER).astype(np.int64)]


def stretches(docs: DataFrame) -> DataFrame:
    """(rk, start, count, times, mini, seg): the stretches of every text; seg is a 16-byte hash of the bytes.

    Equal stretches in a row, as in a text of one repeated word, are one line with their number in times.
    """

    def run(batches):
        for batch in batches:
            for rk, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for start, count, mini in _stretches(data):
                    segs = [
                        hashlib.blake2b(data[s : s + c + LENGTH - 1], digest_size=16).digest()
                        for s, c in zip(start.tolist(), count.tolist(), strict=True)
                    ]
                    new = [i for i, seg in enumerate(segs) if not i or seg != segs[i - 1]]
                    times = np.diff([*new, len(segs)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([rk.as_py()] * len(new), pa.binary()),
                            pa.array(start[new].astype(np.int32)),
                            pa.array(count[new].astype(np.int32)),
                            pa.array(times.astype(np.int32)),
                            pa.array(mini[new].view(np.int64)),
                            pa.array([segs[i] for i in new], pa.binary()),
                        ],
                        ["rk", "start", "count", "times", "mini", "seg"],
                    )

    return _keyed(docs).select("rk", "text").mapInArrow(
        run, "rk binary, start int, count int, times int, mini long, seg binary"
    )


def _mark(part: bytes) -> int:
    return int(np.argmin(byte_windows(np.frombuffer(part[:LENGTH], np.uint8), MARK) & _UPPER))


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(grp, seg, kinds, mark, bytes) for (rk, start, count, mini, seg, kinds); mark is the minimizer's place in the bytes of a large group, else null."""
    most = ARRAY_ROWS
    lists = wanted.groupBy("rk").agg(F.collect_list(F.struct("start", "count", "mini", "seg", "kinds")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rows = asked.as_py()
                parts = [data[r["start"] : r["start"] + r["count"] + LENGTH - 1] for r in rows]
                places = [_mark(part) if r["kinds"] > most else None for r, part in zip(rows, parts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["mini"] for r in rows], pa.int64()),
                        pa.array([r["seg"] for r in rows], pa.binary()),
                        pa.array([r["kinds"] for r in rows], pa.int64()),
                        pa.array(places, pa.int32()),
                        pa.array(parts, pa.binary()),
                    ],
                    ["grp", "seg", "kinds", "mark", "bytes"],
                )

    texts = _keyed(docs).join(lists, "rk").select("text", "wanted")
    return texts.mapInArrow(run, "grp long, seg binary, kinds long, mark int, bytes binary")


def _flag_rows(grp: list, seg: list, parts: list[bytes]):
    flags, at = repeated_starts(parts, LENGTH), 0
    for g, s, part in zip(grp, seg, parts, strict=True):
        start, end = runs(flags[at : at + len(part)])
        at += len(part) + 1
        if len(start):
            yield g, s, start.tolist(), end.tolist()


def _by_suffix_arrays(parts: DataFrame) -> DataFrame:
    """(grp, seg, starts, ends): runs of repeated strings in stretches of one group.

    The rows come sorted by group; whole groups are gathered up to ARRAY_BYTES and sorted together.
    """

    def run(batches):
        groups, segs, texts, size, last = [], [], [], 0, None

        def flush():
            rows = list(_flag_rows(groups, segs, texts)) if texts else []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                ],
                ["grp", "seg", "starts", "ends"],
            )

        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for g, s, text in zip(*columns, strict=True):
                if g != last and size >= ARRAY_BYTES:
                    yield flush()
                    groups, segs, texts, size = [], [], [], 0
                last = g
                groups.append(g)
                segs.append(s)
                texts.append(text)
                size += len(text)
        yield flush()

    parts = parts.select("grp", "seg", "bytes").repartition("grp").sortWithinPartitions("grp")
    return parts.mapInArrow(run, "grp long, seg binary, starts array<int>, ends array<int>")


def _pieces(part: bytes, mark: int, spread: int):
    """(first string, core, bytes) of the pieces of a stretch; the core is what all strings of a piece share, told apart by its distance from the mark."""
    strings = len(part) - LENGTH + 1
    for j in range(max(0, mark - strings + 1) // spread, mark // spread + 1):
        near, far = mark - spread * j, mark - spread * j - spread + 1
        low, high = max(0, far), min(strings - 1, near)
        core = hashlib.blake2b(part[near : far + LENGTH] + j.to_bytes(2), digest_size=8).digest()
        yield low, core, part[low : high + LENGTH]


def _cut(parts: DataFrame, spread: int) -> DataFrame:
    """(grp, seg, first, core, sub, mark, bytes): the pieces of the stretches; sub is a 16-byte hash of the bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                g, s, mark, part = (batch.column(c)[i].as_py() for c in ("grp", "seg", "mark", "bytes"))
                for first, core, piece in _pieces(part, mark, spread):
                    sub = hashlib.blake2b(piece, digest_size=16).digest()
                    rows.append((g, s, first, int.from_bytes(core, signed=True), sub, mark - first, piece))
            types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "seg", "first", "core", "sub", "mark", "bytes"])

    return parts.select("grp", "seg", "mark", "bytes").mapInArrow(
        run, "grp long, seg binary, first int, core long, sub binary, mark int, bytes binary"
    )


def _several(kinds: DataFrame) -> DataFrame:
    """(grp, kinds) of groups of two or more different stretches; written, so that a join with it can split a hot group."""
    return materialize(kinds.groupBy("grp").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-several")


def settled(parts: DataFrame, level: int = 0) -> DataFrame:
    """(grp, seg, starts, ends) for (grp, seg, kinds, mark, bytes), one row for each different stretch of a group."""
    large = parts.where(F.col("kinds") > ARRAY_ROWS)
    if level == len(SPREADS) or large.isEmpty():
        return _by_suffix_arrays(parts)
    found = _by_suffix_arrays(parts.where(F.col("kinds") <= ARRAY_ROWS))
    pieces = materialize(_cut(large, SPREADS[level]), "suffix-pieces")
    subs = pieces.groupBy(F.col("core").alias("grp"), F.col("sub").alias("seg")).agg(
        F.count("*").alias("n"), F.first("mark").alias("mark"), F.first("bytes").alias("bytes")
    )
    subs = materialize(subs, "suffix-subs")
    again = subs.where("n > 1").select("grp", "seg", F.array(F.lit(0)).alias("starts"), F.array(F.length("bytes") - LENGTH + 1).alias("ends"))
    deeper = settled(subs.drop("n").join(_several(subs), "grp"), level + 1)
    flags = materialize(again.union(deeper).select(F.col("grp").alias("core"), F.col("seg").alias("sub"), "starts", "ends"), "suffix-flags")
    shift = lambda c: F.transform(c, lambda x: x + F.col("first"))
    mine = pieces.drop("bytes", "mark").join(flags, ["core", "sub"])
    return found.union(mine.select("grp", "seg", shift("starts").alias("starts"), shift("ends").alias("ends")))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(rk, runs): per row key, the half-open byte ranges of starts of repeated LENGTH-byte strings."""
    small_batches(docs.sparkSession)
    table = materialize(stretches(docs), "suffix-stretches")
    one = F.min(F.struct("rk", "start", "count")).alias("at")
    kinds = table.groupBy(F.col("mini").alias("grp"), "seg").agg(F.sum("times").alias("n"), one)
    twice = materialize(table.groupBy(F.col("mini").alias("grp")).agg(F.sum("times").alias("n")).where("n > 1").select("grp"), "suffix-twice")
    kinds = materialize(kinds.join(twice, "grp"), "suffix-kinds")
    discard(twice)
    wanted = kinds.join(_several(kinds), "grp").select("at.*", F.col("grp").alias("mini"), "seg", "kinds")
    parts = materialize(_bytes_of(docs, wanted), "suffix-bytes")
    whole = kinds.where("n > 1").select("grp", "seg", F.array(F.lit(0)).alias("starts"), F.array(F.lit(-1)).alias("ends"))
    flagged = whole.union(settled(parts)).withColumnRenamed("grp", "mini")
    flagged = materialize(flagged, "suffix-flagged")
    discard(parts, kinds)
    end = lambda x: F.when(x < 0, F.col("count") * F.col("times")).otherwise(x)  # noqa: E731  -1: all strings
    at = table.join(flagged, ["mini", "seg"]).select(
        "rk",
        F.transform(
            F.arrays_zip("starts", "ends"),
            lambda x: F.struct((F.col("start") + x["starts"]).alias("a"), (F.col("start") + end(x["ends"])).alias("b")),
        ).alias("part"),
    )
    return at.groupBy("rk").agg(F.flatten(F.collect_list("part")).alias("runs"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept_bytes, spans, n_bytes, n_removed, n_spans, kept_sha256.

    ``spans`` are the maximal removed byte ranges [start, end).
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                start = end = np.zeros(0, np.int64)
                if found.is_valid:
                    a = found.values.field("a").to_numpy().astype(np.int64)
                    b = found.values.field("b").to_numpy().astype(np.int64)
                    start, end = runs(cover(len(data), a, b + LENGTH - 1))
                edge = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edge[::2], edge[1::2], strict=True))
                spans = [{"start": i, "end": j} for i, j in zip(start.tolist(), end.tolist(), strict=True)]
                gone = len(data) - len(kept)
                rows.append((kept, spans, len(data), gone, len(spans), hashlib.sha256(kept).hexdigest()))
            types = [pa.binary(), span, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            data = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            names = ["kept_bytes", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *data], ["doc_id", *names])

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    joined = _keyed(docs).join(materialize(repeated_runs(docs), "suffix-runs"), "rk", "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(
        run,
        "doc_id long, kept_bytes binary, spans array<struct<start: long, end: long>>, n_bytes long, n_removed long, "
        "n_spans long, kept_sha256 string",
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept_bytes", "spans")
