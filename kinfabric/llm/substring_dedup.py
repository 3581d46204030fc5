"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words. Only the ``ANCHOR``-word strings at positions of a difference
cover modulo ``PERIOD`` are hashed. For any two positions i and j there is a shift below PERIOD that puts
both into the cover, and PERIOD - 1 + ANCHOR <= window, so two equal windows always share an anchor at
one shift, whatever their alignments. Windows within reach of an anchor that another document has too
are extended to their full length: their 128-bit hashes are grouped and the smallest doc_id of each
found. All other windows are unique and never leave their task.

Documents with equal word sequences are one class; only rows of the class's smallest doc_id enter the
search, the others go whole (if they have a window at all).

Hashes of words, windows and sequences are 128 bits from two independent 64-bit hashes; words are not compared again.

Defined cases: null texts have no words; texts shorter than a window lose nothing; texts of any length are one row;
rows with a null doc_id are left whole and remove nothing elsewhere; rows that share a doc_id don't remove one another's
words, and each is reported on its own; only doc_id and text are read, so other columns don't clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfabric.llm.hashing import U64, cover, gram_hashes, mix, window_hashes, word_hashes
from kinfabric.llm.shared import documents, materialize

#: The perfect difference set of 31 with 6 elements: each residue is a difference of two of them.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WINDOW, ANCHOR = 50, 20
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD)) and PERIOD - 1 + ANCHOR <= WINDOW
_COVERED = np.isin(np.arange(PERIOD), COVER)


def _places(n: int) -> np.ndarray:
    """The cover positions below n, in order."""
    at = np.arange(n)
    return at[_COVERED[at % PERIOD]]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word: words that agree in one differ in the other."""
    return word_hashes(data), word_hashes(data, seed=5)


def _sequence(words: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """A 128-bit hash of a word sequence, as two signed integers."""
    one, other = words
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, len(one) + 1, dtype=U64))
        two = np.array([mix(one ^ place).sum(), mix(other + place * U64(3)).sum()], U64) + U64(len(one))
    return tuple(two.view(np.int64).tolist())


def _bytes(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, s1, s2 (hash of the word sequence), anchors (hashes at the cover positions)."""

    def run(batches):
        for batch in batches:
            both = [_words(_bytes(text)) for text in batch.column(1)]
            two, found = [_sequence(w) for w in both], [w[0] for w in both]
            anchors = [g[_places(len(g))] if len(w) >= WINDOW else g[:0] for w in found for g in [gram_hashes(w, ANCHOR)]]
            ends = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
            flat = pa.array(np.concatenate([*anchors, np.zeros(0, U64)]).view(np.int64))
            columns = [
                batch.column(0),
                pa.array([len(w) for w in found], pa.int64()),
                pa.array([t[0] for t in two], pa.int64()),
                pa.array([t[1] for t in two], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "s1", "s2", "anchors"])

    return _ids(docs).mapInArrow(run, "doc_id long, n_words long, s1 long, s2 long, anchors array<long>")


def _windows(texts: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, start, w1, w2) for the windows within reach of a shared anchor.

    ``texts``: doc_id, text, s1, s2 and marks, the indexes of its shared anchors among its cover positions.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                both = _words(_bytes(batch.column("text")[row]))
                two, words = _sequence(both), both[0]
                if two != (batch.column("s1")[row].as_py(), batch.column("s2")[row].as_py()):
                    continue  # another row of the same doc_id
                at = _places(len(words) - ANCHOR + 1)[batch.column("marks")[row].values.to_numpy()]
                n = len(words) - WINDOW + 1
                near = np.flatnonzero(cover(n, np.clip(at - PERIOD + 1, 0, n), np.clip(at + 1, 0, n)))
                wide = [window_hashes(w, WINDOW, seed) for w, seed in zip(both, (11, 23), strict=True)]
                for part in np.array_split(near, len(near) // 100_000 + 1):
                    one, other = (w[part].view(np.int64) for w in wide)
                    same = [pa.array(np.full(len(part), v)) for v in (batch.column("doc_id")[row].as_py(), *two)]
                    columns = [*same, pa.array(part.astype(np.int32)), pa.array(one), pa.array(other)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "start", "w1", "w2"])

    return texts.select("doc_id", "text", "s1", "s2", "marks").mapInArrow(
        run, "doc_id long, s1 long, s2 long, start int, w1 long, w2 long"
    )


def removed_windows(docs: DataFrame, long: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, starts): the starts of the windows that a smaller doc_id has too.

    ``long``: :func:`sequences` of a window or more; ``first``: the smallest doc_id of each class of equal ones.
    """
    spread = long.join(first.select(F.col("first").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"]).select("doc_id", "s1", "s2", F.posexplode("anchors").alias("i", "a"))
    spread = materialize(spread, "sub-anchors")
    shared = spread.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialize(shared.where("low < high").select("a"), "sub-shared")
    hit = spread.join(shared, "a").groupBy("doc_id", "s1", "s2").agg(F.sort_array(F.collect_set("i")).alias("marks"))
    hit = materialize(hit, "sub-marks")
    windows = materialize(_windows(_ids(docs).join(hit, "doc_id")).distinct(), "sub-windows")
    owner = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    owner = materialize(owner.where("low < high").select("w1", "w2", "low"), "sub-owners")
    later = windows.join(owner, ["w1", "w2"]).where("doc_id > low")
    later = later.groupBy("doc_id", "s1", "s2").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return materialize(later, "sub-starts")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept_text, n_words, n_removed, kept_sha256.

    kept_text holds the kept words joined by one space.
    """
    marks = materialize(sequences(docs), "sub-sequences")
    long = marks.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    # written, so that the joins with it can split a class that holds very many copies
    first = materialize(long.groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("first")), "sub-first")
    starts = removed_windows(docs, long, first)
    copies = long.select("doc_id", "s1", "s2", "n_words").join(first, ["s1", "s2", "n_words"]).where("doc_id > first")
    whole = copies.select("doc_id", "s1", "s2", F.array(F.lit(-1)).alias("starts")).distinct()
    changed = starts.union(whole).groupBy("doc_id")
    changed = changed.agg(F.collect_list(F.struct("s1", "s2", "starts")).alias("changes"))

    def run(batches):
        for batch in batches:
            kept = []
            for text, changes in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = data.split()
                n, gone = len(words), 0
                if changes.is_valid:
                    two = _sequence(_words(data))
                    for change in changes.as_py():
                        if (change["s1"], change["s2"]) == two:
                            at = np.array(change["starts"], np.int64)
                            if at[0] < 0:
                                words, gone = [], n
                            else:
                                out = cover(n, at, at + WINDOW)
                                words, gone = [w for w, x in zip(words, out, strict=True) if not x], int(out.sum())
                            break
                text = b" ".join(words)
                kept.append((n, gone, text, hashlib.sha256(text).hexdigest()))
            names = ["n_words", "n_removed", "kept_text", "kept_sha256"]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
            data = [pa.array([k[i] for k in kept], t) for i, t in enumerate(types)]
            data[2] = data[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *data], ["doc_id", *names])

    joined = _ids(docs).join(changed, "doc_id", "left").select("doc_id", "text", "changes")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.select("doc_id", "kept_text", "n_words", "n_removed", "kept_sha256")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")
