"""Packing into optimal length buckets.

The global histogram of lengths is exact; dynamic programming over it picks the bucket boundaries with the
least padding, each the largest length of its bucket. D distinct lengths need D * (D - 1) / 2 words at least, so
the histogram grows with the square root of the corpus; a lower envelope of lines makes a bucket's turn linear
in it. Inside a bucket, batches hold as many documents as the token budget pays for at the bucket's
padded length. Ranks inside a bucket come from slices of about ``SLICE_ROWS`` documents and offsets, so a
bucket that holds a third of all rows is no single task.

Lengths are tokens; ``pack`` takes any others.

Defined cases: null and empty texts have length 0; a document longer than the budget is a batch of its own, however
long; documents of one length are ordered by doc_id (nulls first), and rows that repeat are packed each on their own;
only doc_id and text are read, so other columns don't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfabric.llm.shared import documents, materialize, small_batches
from kinfabric.llm.tokens import TOKENIZER, token_lengths

BUCKETS, BUDGET, SLICE_ROWS = 16, 16384, 4096


def _covered(best: list, total: list, a: int, b: int, c: int) -> bool:
    """Whether line ``b`` is nowhere below both ``a`` and ``c``."""
    return (best[c] - best[a]) * (total[b] - total[a]) <= (best[b] - best[a]) * (total[c] - total[a])


def best_boundaries(edges: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` edges, the last included, that minimise the sum of padded lengths."""
    n = len(edges)
    if n == 0:
        return []
    sizes = [int(e) for e in edges]
    total = [0, *np.cumsum(counts).tolist()]  # Python's integers: exact products
    best: list[int | None] = [0] + [None] * n
    choice = []
    for _ in range(min(buckets, n)):
        now: list[int | None] = [0] + [None] * n
        pick = np.zeros(n + 1, np.int64)
        # a bucket that starts behind i and ends at size x costs best[i] - total[i] * x + total[j] * x: the lower
        # envelope of lines that fall ever steeper, asked at growing x
        hull, front = [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - front >= 2 and _covered(best, total, hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            x = sizes[j - 1]
            while front + 1 < len(hull) and best[hull[front + 1]] - total[hull[front + 1]] * x < best[hull[front]] - total[hull[front]] * x:
                front += 1
            at = hull[front]
            now[j], pick[j] = best[at] + x * (total[j] - total[at]), at
        best = now
        choice.append(pick)
    out, j = [], n
    for pick in reversed(choice):
        if j == 0:
            break
        out.append(int(edges[j - 1]))
        j = int(pick[j])
    return out[::-1]


def pack(rows: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, length, bucket, padded, batch, padding) for rows (doc_id, length).

    ``bucket`` counts from 0, ``padded`` is the bucket's boundary, ``batch`` counts within the bucket, and
    a batch's documents times ``padded`` stay within ``budget`` unless it holds a single document.
    """
    rows = materialize(rows.select("doc_id", F.col("length").cast("long").alias("length")), "pack-lengths")
    bins = rows.groupBy("length").agg(F.count("*").alias("n")).toArrow().sort_by("length")
    bounds = best_boundaries(bins["length"].to_numpy(), bins["n"].to_numpy(), buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    rows = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("length"))))
    rows = rows.withColumn("padded", F.element_at(limits, F.col("bucket") + 1))
    held = rows.groupBy("bucket").agg(F.count("*").alias("held"))
    slices = F.ceil(F.col("held") / SLICE_ROWS)
    rows = rows.join(F.broadcast(held), "bucket")  # at most ``buckets`` rows
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "length"), slices)).drop("held")
    rows = materialize(rows, "pack-slices")
    sums = rows.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "slice").orderBy("length", "doc_id")
    rank = F.col("offset") + F.row_number().over(inside) - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded"))))
    out = rows.join(offsets, ["bucket", "slice"]).withColumn("rank", rank)
    return out.select(
        "doc_id", "length", "bucket", "padded", F.floor(F.col("rank") / fit).alias("batch"), (F.col("padded") - F.col("length")).alias("padding")
    )


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, path: str = TOKENIZER) -> DataFrame:
    """:func:`pack` with tokens as lengths; ``path`` is the tokenizer's vocabulary."""
    small_batches(docs.sparkSession)
    return pack(token_lengths(docs, path), buckets, budget)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
