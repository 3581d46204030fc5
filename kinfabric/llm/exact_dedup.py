"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups.

Defined cases: a null text counts as empty and empty texts are equal to one another; a row whose
doc_id is null takes part in its group but is kept only if all ids of the group are null; rows that
repeat both text and doc_id all carry the same keep_id and are all kept when it is theirs. Texts of any length
are one value, hashed and compared whole; an empty table gives an empty result. Columns
of the input beyond ``id_col`` and ``text_col`` are left out of the decisions and don't clash, as only
those two are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfabric.llm.shared import documents, free_name, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Slices of a group of equal hashes whose texts are compared apart before the slices meet.
SLICES = 16


def ascii_lower(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, everything else unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = ascii_lower,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``min`` or ``max``: which id of a group of equal texts stays. Only ids and hashes of all
    rows are shuffled; texts move only for hashes that occur twice or more, sliced by id so that a hash
    shared by a third of all rows is no single task. Two texts of one hash are told apart by their bytes.
    """
    best = {"min": F.min, "max": F.max}[keep]
    norm = normalise(F.col(text_col))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    keyed = keyed.select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))
    marks = keyed.select("doc_id", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("s"))
    marks = materialize(marks, "exact-marks")
    repeated = marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    slices = repeated.select("h", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    members = keyed.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    sliced = members.join(slices, ["h", "slice"]).groupBy("h", "slice", "norm")
    sliced = sliced.agg(F.count("*").alias("n"), best("doc_id").alias("keep_id"))
    classes = sliced.groupBy("h", "norm").agg(F.sum("n").alias("n"), best("keep_id").alias("keep_id"))
    # one text for each pair of hashes: a pair that two texts share would be an error, never a merge
    classes = classes.withColumn("s", F.unhex(F.sha2(F.col("norm").cast("binary"), 256))).groupBy("h", "s")
    classes = classes.agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.max("keep_id").alias("keep_id"))
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long"))
    classes = classes.select("h", "s", checked.otherwise(F.col("n")).alias("n"), "keep_id", F.lit(True).alias("grouped"))
    # written, so that the join with it can split a class that holds very many rows
    out = marks.join(materialize(classes, "exact-classes"), ["h", "s"], "left")
    keep_id = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "min", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts (also one of rows that repeat id and text).

    The decisions are a written table of ids and hashes; with them, the texts are shuffled once more.
    """
    name = free_name(docs, "_row")
    row = lambda doc_id, s: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("~")), s).alias(name)
    classes = exact_classes(docs, keep=keep, **options).where("kept")
    kept = materialize(classes.select(row(F.col("doc_id"), F.col("text_sha256"))), "exact-kept")
    text = docs[options.get("text_col", "text")]
    normalise = options.get("normalise", ascii_lower)
    rows = docs.withColumn(name, row(docs[options.get("id_col", "doc_id")].cast("long"), F.sha2(normalise(text).cast("binary"), 256)))
    if not kept.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = rows.dropDuplicates([name])
    return rows.join(kept.distinct(), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(documents(spark, sf_dir), keep="max")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d
"""
