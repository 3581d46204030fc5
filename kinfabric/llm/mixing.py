"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Each document draws the key -ln(u) / w, u a hash of seed and id, w its quality weight; the smallest keys
of a source form its weighted sample without replacement. A source's budget first pays for complete epochs
over all of its documents; what is left goes down the sorted keys by prefix sums.

A source may hold a third of all rows, so its prefix sums are not one window. The keys' distribution within
a source is known (a mixture of exponentials over its histogram of weights), and cutting it into equal
shares gives buckets of about ``BUCKET_ROWS`` documents. Sums per bucket give each bucket's offset; only
the rows of one bucket are sorted together.

The document at the edge of a budget is the one whose size comes nearest to what is left, not the next of the order: a
target is then met to within half the smallest spare document instead of half the next one, which may be very long.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null source is one source, last in
order; rows that repeat are documents of their own, and equal keys are ordered by doc_id and size; a very long text
counts whole and is taken whole or not at all; columns of the input that clash with helpers are kept; an empty table
gives an empty result; a source whose texts are all empty has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfabric.llm.shared import documents, free_name, materialize

WORD = r"[^\x20\x09-\x0D]+"
NOISE = r"[!#$%&*|]+"
#: Weights of the sources by code point, repeating; the share of all sizes to hand out; epochs at most.
PATTERN, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
BUCKET_ROWS = 4096
_PLACED = ("doc_id", "source", "g", "size", "source_size", "target", "sum", "whole", "left", "inside")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_level(text: Column, size: Column) -> Column:
    """A weight from 1 to 100 hundredths: words over words and runs of noise characters."""
    noise = F.coalesce(F.regexp_count(text, F.lit(NOISE)), F.lit(0)).cast("long")
    share = F.when(size + noise > 0, F.floor(100 * size / (size + noise))).otherwise(100)
    return F.greatest(F.lit(1), share).cast("int")


def _in_order(rows: DataFrame, order: list, name: str, parts: int = 64) -> DataFrame:
    """``rows``, written, dealt out by range of ``order`` with the number of their range in ``part``, so that no window holds them all."""
    return materialize(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)


def _running(rows: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with running sums in ``order``, the row itself left out, and in ``<name>_all`` the sums over all rows."""
    rows = _in_order(rows, order, name)
    held = rows.groupBy("part").agg(*[F.sum(c).alias(f"{k}_held") for k, c in sums.items()])
    ahead = Window.orderBy("part")  # one row a range
    firsts = held.select(
        "part",
        *[F.coalesce(F.sum(f"{k}_held").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{k}_first") for k in sums],
        *[F.sum(f"{k}_held").over(Window.partitionBy()).alias(f"{k}_all") for k in sums],
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(firsts), "part")  # at most ``parts`` rows
    before = {k: F.col(f"{k}_first") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}
    return out.withColumns(before).drop("part", *[f"{k}_first" for k in sums])


def source_targets(sizes: DataFrame, pattern=PATTERN, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """(source, g, source_size, n, target) for rows (source, size): one row a source.

    Targets share ``share`` of all sizes by weight and stop at ``epochs`` times their source; the excess goes
    to the others by weight until none is above. The level at which that ends is found by one ordered pass
    over the sources instead of rounds: with the sources in order of cap over weight, it is the first one
    that stays under its cap when all before it are capped. Both orders run over ranges of sources, as there may
    be as many as web domains.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = _running(per, [F.col("source").asc_nulls_last()], {"g": F.lit(1)}, "mix-sources").withColumn("g", F.col("g") + 1).drop("g_all")
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    per = per.withColumn("w", F.element_at(weights, ((F.col("g") - 1) % len(pattern) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("turn", F.col("cap") / F.col("w"))
    sums = {"before": F.col("cap"), "light": F.col("w"), "size": F.col("source_size")}
    per = materialize(_running(per, [F.col("turn"), F.col("g")], sums, "mix-turns"), "mix-levels")
    rest = F.col("light_all") - F.col("light")
    per = per.withColumn("level", (F.col("size_all") * F.lit(float(share)) - F.col("before")) / rest)
    fits = per.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("turn", "g", "level")).alias("first"))
    per = per.drop("level").join(F.broadcast(fits.select(F.col("first.level").alias("level"))))  # one row
    target = F.coalesce(F.least(F.col("level") * F.col("w"), "cap"), F.col("cap"))
    return per.select("source", "g", "source_size", "n", target.alias("target"))


def mix(rows: DataFrame, seed: int = 0, bucket_rows: int = BUCKET_ROWS, **targets) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for rows (doc_id, source, size, level).

    ``level`` is the quality weight in hundredths, 1 to 100. ``taken`` is the number of words that the mix
    takes of the document: whole epochs times its size, and its size once more if it lies in the fractional
    selection: the prefix that the budget covers, and one more document, the one whose size comes nearest
    to what is then left of the budget, if it brings the sum nearer to the target.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))), 1, 12), 16, 10)
    u = (draw.cast("long") + 0.5) / F.lit(float(1 << 48))
    rows = materialize(rows.select("doc_id", "source", "size", "level"), "mix-sizes")
    per = materialize(source_targets(rows, **targets), "mix-targets")
    levels = rows.groupBy("source", "level").agg(F.count("*").alias("k"))
    shares = levels.groupBy("source").agg(F.collect_list(F.struct((F.col("level") / 100.0).alias("w"), "k")).alias("shares"))
    per = per.join(shares.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source")
    per = materialize(per, "mix-shares")  # written, so that the join with it can split a source
    keyed = rows.join(per, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    keyed = keyed.withColumn("key", -F.log(u) / (F.col("level") / 100.0))
    below = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x["k"] * (1 - F.exp(-x["w"] * F.col("key")))) / F.col("n")
    buckets = F.ceil(F.col("n") / bucket_rows)
    keyed = keyed.withColumn("bucket", F.least(buckets - 1, F.floor(buckets * below))).drop("shares")
    keyed = materialize(keyed, "mix-keys")
    sums = keyed.groupBy("g", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("g", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("g", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(offsets, ["g", "bucket"]).withColumn("sum", F.col("offset") + F.sum("size").over(inside))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("whole", whole.cast("int"))
    placed = placed.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    placed = placed.withColumn("inside", F.col("sum") <= F.col("left"))
    placed = materialize(placed.select(*_PLACED), "mix-placed")
    full = placed.groupBy("g").agg(F.first("left").alias("left"), F.max(F.when(F.col("inside"), F.col("sum"))).alias("full"))
    gaps = full.select("g", (F.col("left") - F.coalesce("full", F.lit(0))).alias("gap"))
    spare = placed.where("NOT inside AND size > 0").join(gaps, "g").where("abs(size - gap) < gap")
    last = spare.groupBy("g").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "sum")).alias("last"))
    placed = placed.join(last.select("g", F.col("last.sum").alias("last")), "g", "left")
    chosen = F.col("inside") | (F.coalesce(F.col("sum") == F.col("last"), F.lit(False)) & (F.col("size") > 0))
    copies = F.col("whole") + chosen.cast("int")
    taken = (F.col("size") * copies).cast("long").alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken, copies.alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, level) of documents: words, and a quality weight from the text."""
    size = word_count(F.col("text"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), quality_level(F.col("text"), size).alias("level"))


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` as mixed: each document as often as the mix takes it, not at all where it takes none.

    Of rows that share a doc_id, all are taken as often as the first. Empty documents (size 0) stay once.
    """
    copies, again = free_name(docs, "_copies"), free_name(docs, "_again")
    key, held = free_name(docs, "_id"), free_name(docs, "_size")
    takes = mix(sized(docs), seed).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies), F.max("size").alias(held))
    rows = docs.join(takes, docs["doc_id"].eqNullSafe(F.col(key)))
    times = F.when(F.col(held) == 0, 1).otherwise(F.col(copies))
    rows = rows.where(times > 0).withColumn(again, F.explode(F.sequence(F.lit(1), times)))
    return rows.select(*[docs[c] for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(documents(spark, sf_dir))).drop("source", "copies")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[!#$%&*|]+')) AS noise,
    (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '~')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u::DOUBLE) / (greatest(1, CASE WHEN size + noise = 0 THEN 100
    ELSE (100 * size) // (size + noise) END) / 100.0)::DOUBLE AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS g FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((g - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, g
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, g
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, g LIMIT 1),
t AS (SELECT source, source_size, least(f.level * w, cap) AS target FROM l, f),
p AS (SELECT doc_id, k.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, upto <= target - whole * source_size AS inside FROM p),
g AS (SELECT source, max(target - whole * source_size) - coalesce(max(upto) FILTER (inside), 0) AS gap FROM q GROUP BY source),
e AS (SELECT q.source, min(struct_pack(d := abs(size - gap), u := upto)) AS pick FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
  WHERE NOT inside AND size > 0 AND abs(size - gap) < gap GROUP BY q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + (inside OR (size > 0 AND coalesce(upto = e.pick.u, false)))::INT))::BIGINT AS taken
FROM q LEFT JOIN e ON q.source IS NOT DISTINCT FROM e.source
"""
