"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gives ``positions`` b-bit MinHash values. They are cut into chunks;
by the pigeonhole principle two signatures that differ in at most ``chunks * (errors + 1) - 1`` positions
have a chunk with at most ``errors`` differences, so entering every chunk under each choice of ``errors``
left-out positions finds all such pairs. The threshold gives the number of chunks: at 0.85 it is 10 (of 5, one
error) and the guaranteed distance 19 of 50, which a pair on the threshold exceeds with probability 1.6e-5; at
0.8 it is 12 (of 4 or 5) and 23, exceeded with probability 8.3e-6.

Candidates are confirmed by the exact similarity of the full shingle sets. Pairs of a bucket are never
all emitted. In a few rounds each document is tried against the nearest of its buckets' pivots, one id a
bucket and round, and components are formed from the links found; in one more round against the nearest
document of another component that a scan of its buckets finds. Then only pairs of a bucket that lie in
different components and within the guaranteed distance are tried, found tile by tile, each pair in the
first bucket it shares. A second signature of 1024 8-bit positions, made of the full sets of only the documents
that are left, spares the exact comparison of pairs that lie more than 4.75 standard deviations beyond the
threshold (a pair on the threshold is lost with probability 1e-6). As all pairs of a bucket within one component are linked already, no link that
would join two components is lost.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component;
texts with fewer words than a shingle are one shingle, their whole sequence; a text of any length is one row, its
whole set is compared; documents with equal sets are linked; rows that share a doc_id are one document, linked if one
of its rows is, each row reported; rows with a null doc_id link with nothing and are kept with a null component; only
doc_id and text are read, so other columns don't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfabric.llm.components import roots
from kinfabric.llm.hashing import U64, gram_hashes, mix, word_hashes
from kinfabric.llm.shared import discard, documents, materialize

POSITIONS, CHUNKS, ERRORS = 50, 10, 1
ROUNDS, TILE, FINE = 2, 2048, 1024
#: A pair on the threshold is beyond the guaranteed distance with at most this probability.
MISS = 2e-5


def chunks_for(percent: int) -> int:
    """The fewest chunks, ``CHUNKS`` at least, whose guaranteed distance a pair on the threshold exceeds with at most ``MISS``."""
    q = (1 - percent / 100) * (1 - 2.0**-16)
    for chunks in range(CHUNKS, POSITIONS // (ERRORS + 1)):
        over = range(chunks * (ERRORS + 1), POSITIONS + 1)
        if sum(math.comb(POSITIONS, k) * q**k * (1 - q) ** (POSITIONS - k) for k in over) <= MISS:
            return chunks
    return POSITIONS // (ERRORS + 1)


def places_of(chunks: int) -> list[tuple[int, ...]]:
    """The positions of each index key: a chunk less each choice of left-out ones."""
    cuts = [POSITIONS * c // chunks for c in range(chunks + 1)]
    return [places for a, b in itertools.pairwise(cuts) for places in itertools.combinations(range(a, b), b - a - ERRORS)]


PLACES = places_of(CHUNKS)
_A = mix(np.arange(1, POSITIONS + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_B = mix(_A + U64(7))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's n-word shingles, A-Z lower-cased."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if 0 < len(words) < n:
        return gram_hashes(words, len(words), seed=len(words))
    return np.unique(gram_hashes(words, n))


def signature(shingles: np.ndarray) -> np.ndarray:
    """b-bit MinHash, b = 16: the low bits of the mixed minimum of each of the positions' hashes."""
    low = np.full(POSITIONS, np.iinfo(U64).max, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096, None] * _A[None, :] + _B[None, :]
            np.minimum(low, part.min(axis=0), out=low)
    return mix(low).astype(np.uint16)


_FINE_A = mix(np.arange(1, FINE + 1, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)
_FINE_B = mix(_FINE_A + U64(9))


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(FINE, np.iinfo(U64).max, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(low, (shingles[at : at + 512, None] * _FINE_A[None, :] + _FINE_B[None, :]).min(axis=0), out=low)
    return mix(low).astype(np.uint8)


def fine_reach(percent: int) -> int:
    """Differences that the second signature allows: the mean at the threshold and 4.75 deviations."""
    q = (1 - percent / 100) * (1 - 2.0**-8)
    return int(FINE * q + 4.75 * (FINE * q * (1 - q)) ** 0.5) + 1


def _fine(sets: DataFrame) -> DataFrame:
    """(id, fine) for (id, shingles)."""

    def run(batches):
        for batch in batches:
            fine = [fine_signature(x.values.to_numpy().view(U64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], ["id", "fine"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, fine binary")


def _pair(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a sorted set, as signed integers."""
    with np.errstate(over="ignore"):
        two = np.array([mix(hashes + U64(1)).sum(), mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5)).sum()], U64)
    return tuple(two.view(np.int64).tolist())


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128-bit hash of the set), sig (binary)."""

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("n", "s1", "s2", "sig")}
            for text in batch.column(1):
                found = shingle_set(text.as_py(), n)
                s1, s2 = _pair(found)
                for k, v in zip(rows, (len(found), s1, s2, signature(found).tobytes()), strict=True):
                    rows[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            data = [pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *data], ["doc_id", "n_shingles", "s1", "s2", "sig"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def index_keys(classes: DataFrame, index: list[tuple[int, ...]] = PLACES) -> DataFrame:
    """(key, k, id): each signature under every chunk and every choice of left-out positions, numbered k."""

    def run(batches):
        for batch in batches:
            sig = _sigs(batch.column(1)).astype(U64)
            keys = np.empty((len(sig), len(index)), U64)
            with np.errstate(over="ignore"):
                for k, places in enumerate(index):
                    key = np.zeros(len(sig), U64)
                    for p in places:
                        key = (key << U64(16)) | sig[:, p]
                    keys[:, k] = mix(mix(key) + U64(1 + k))
            flat = pa.array(keys.reshape(-1).view(np.int64))
            numbers = pa.array(np.tile(np.arange(len(index), dtype=np.int16), len(sig)))
            ids = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(index)))
            yield pa.RecordBatch.from_arrays([flat, numbers, ids], ["key", "k", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, k short, id long")


def _distance(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, distance): the number of signature positions in which a and b differ."""

    def run(batches):
        for batch in batches:
            far = (_sigs(batch.column(2)) != _sigs(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(far, pa.int32())], ["a", "b", "distance"]
            )

    one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a long, b long, distance int")


def _full_sets(ids: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(id, shingles): the full shingle sets of the rows with these ids."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text.as_py(), n).view(np.int64) for text in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "shingles"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    needed = ids.select(F.col("id").alias("doc_id"))
    return texts.join(needed, "doc_id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return materialize(pairs.join(two, "b").join(one, "a").where(linked).select("a", "b").distinct(), "near-links")


def _apart_pairs(apart: DataFrame, wide: DataFrame, reach: int, fine: int, nearest: bool = False, index: list[tuple[int, ...]] = PLACES) -> DataFrame:
    """(a, b, distance) of one bucket, in different components, at most ``reach`` and ``fine`` positions apart.

    ``distance`` is that of the second signatures; with ``nearest``, a row of a tile has one partner at most.

    ``apart``: key, k, id, c; ``wide``: id, sig, fine, which join last, so that they are shuffled once. A bucket of more than TILE rows is cut into tiles by a hash of the id and
    each two tiles meet in a task of their own choice; a pair is emitted only under the first k it shares.
    """
    size = apart.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = apart.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("id", "key"), F.col("tiles")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, F.col("mine")).alias("p"), F.greatest(t, F.col("mine")).alias("q")),
    )
    rows = rows.select("key", "k", "id", "c", "mine", F.explode(met).alias("m")).join(wide, "id")
    rows = rows.select("key", "m.p", "m.q", "mine", "k", "id", "c", "sig", "fine")
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def tile(part: pa.Table):
        mine, ids, comps = (part.column(c).to_numpy() for c in ("mine", "id", "c"))
        sig, k = _sigs(part.column("sig")), int(part.column("k")[0].as_py())
        long = np.frombuffer(b"".join(part.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        p, q = part.column("p")[0].as_py(), part.column("q")[0].as_py()
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        for i in left:
            far = (sig[right] != sig[i]).sum(axis=1)
            hit = right[(far <= reach) & (comps[right] != comps[i])]
            if p == q:
                hit = hit[hit > i]
            apart_by = (long[hit] != long[i]).sum(axis=1)
            hit, apart_by = hit[apart_by <= fine], apart_by[apart_by <= fine]
            if len(hit):
                earlier = np.zeros(len(hit), bool)
                for places in index[:k]:
                    at = list(places)
                    earlier |= (sig[hit][:, at] == sig[i][at]).all(axis=1)
                hit, apart_by = hit[~earlier], apart_by[~earlier]
                if nearest and len(hit):
                    best = int(np.lexsort((ids[hit], apart_by))[0])
                    hit, apart_by = hit[best : best + 1], apart_by[best : best + 1]
                for j, d in zip(hit, apart_by, strict=True):
                    yield (ids[i], ids[j], d) if nearest else (max(ids[i], ids[j]), min(ids[i], ids[j]), d)

    def run(batches):
        held, last = [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = list(zip(*(table.column(c).to_pylist() for c in ("key", "p", "q")), strict=True))
            cuts = [i for i in range(len(marks)) if i and marks[i] != marks[i - 1]]
            for at, end in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if at == end:
                    continue
                if held and marks[at] != last:
                    yield from emit(held)
                    held = []
                held.append(table.slice(at, end - at))
                last = marks[at]
        if held:
            yield from emit(held)

    def emit(held):
        pairs = tile(pa.concat_tables(held))
        while part := list(itertools.islice(pairs, 65536)):
            columns = [pa.array([x[i] for x in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "distance"])

    return rows.mapInArrow(run, "a long, b long, distance int")


def _same_id(marks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the sets of rows that share a doc_id."""
    again = marks.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    rows = marks.join(again.select("doc_id"), "doc_id").join(sets.drop("sig"), ["s1", "s2", "n_shingles"])
    low = rows.groupBy("doc_id").agg(F.min("id").alias("b"))
    return rows.join(low, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def near_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links need 100 * |A & B| >= percent * |A | B| on n-word shingles; component_id is the smallest
    doc_id reachable, and kept says whether it is the document's own.
    """
    chunks = chunks_for(percent)
    reach, index = chunks * (ERRORS + 1) - 1, places_of(chunks)
    marks = materialize(signatures(docs, n), "near-signatures")
    sets = marks.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n_shingles")
    sets = materialize(sets.agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "near-classes")

    keys = index_keys(sets, index)
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = materialize(keys.join(shared.select("key"), "key"), "near-buckets")
    full = materialize(_full_sets(members.select("id").distinct(), docs, n), "near-sets")
    labels = roots(_same_id(marks, sets))
    for step in range(ROUNDS + 2):
        # what still lies apart in a bucket
        placed = members.join(labels, "id", "left").select("key", "k", "id", F.coalesce("component", "id").alias("c"))
        placed = materialize(placed, "near-placed")
        discard(members)
        pivot = F.min_by("id", F.struct(F.xxhash64("id", F.lit(step)), "id")).alias("pivot")
        mixed = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), pivot).where("x < y")
        members = materialize(placed.join(mixed.select("key", "pivot"), "key"), "near-apart")
        discard(placed)
        if step < ROUNDS:
            heads = members.where("id = pivot").select("key", F.col("c").alias("pc"))
            tried = members.join(heads, "key").where("c <> pc").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
            near = _distance(tried.distinct(), sets).where(F.col("distance") <= reach)
        else:
            if step == ROUNDS:
                left = full.join(members.select("id").distinct(), "id", "left_semi")
                wide = materialize(_fine(left).join(sets.select("id", "sig"), "id"), "near-fine")
            near = _apart_pairs(members.select("key", "k", "id", "c"), wide, reach, fine_reach(percent), step == ROUNDS, index)
        if step <= ROUNDS:
            near = near.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
        else:
            near = materialize(near.select("a", "b"), "near-rest").distinct()
        # the stars found so far stand for all links before
        before, fresh = labels, _confirm(near, full, percent)
        labels = roots(fresh.union(before.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        discard(before, fresh)

    classes = sets.join(labels, "id", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("c"))
    out = marks.join(classes, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component."""
    gone = near_components(docs, n, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), n=3, percent=85)
