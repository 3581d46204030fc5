"""Token counts by scanning flat token files for separators.

Texts become flat files of little-endian 16-bit ids in the shared folder, documents one after another, each closed
by the end-of-document id, without an index. A document is led by ``LEAD`` ids under 32,768 that spell its doc_id,
15 bits each, so a file needs no table beside it and the end-of-document id never occurs in them. Spark's own text
sink writes the files, with that id as its record separator, so they can lie in any store that Spark writes to.

The scan reads the files back in blocks that know nothing of documents: a vectorised search finds the
separators of each block, and a prefix scan over the blocks' summaries (tokens, separators, last
separator, ids behind it) stitches documents that cross blocks.

Defined cases: null and empty texts have 0 tokens; a null doc_id is spelt by a bit of its own; the end-of-document id
never occurs inside a document, as the encoder has no special tokens; tokens after the last separator of a file belong
to no document; rows that repeat are documents of their own; a very long text is one record of a file and any number of
blocks; only doc_id and text are read, so other columns don't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfabric.llm.shared import documents, drop_at_exit, materialize, shared_root, small_batches

#: Where the public ranks lie on every machine; each function takes the path as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that goes with these ranks, and the free id for end of document.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK_TOKENS = 1 << 16
#: Ids that spell a doc_id; documents in a file at most.
LEAD, FILE_DOCUMENTS = 5, 4096


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lists(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(ids): the record of each document, its spelt doc_id and its tokens as 16-bit ids."""

    def run(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = 1 << 64 if doc_id is None else doc_id & (2**64 - 1)
                rows.append(np.array([*(name >> 15 * k & 32767 for k in range(LEAD)), *encode(text.as_py() or "")], "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "ids binary")


def write_flat_files(lists: DataFrame, path: str, eod: int = EOD) -> None:
    """Records of ids, each closed by the end-of-document id, at most ``FILE_DOCUMENTS`` to a file."""
    end = eod.to_bytes(2, "little").decode("latin-1")
    rows = lists.select(F.col("ids").cast("string").alias("value"))  # the bytes as they are
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, at, tokens) of flat files of little-endian 16-bit ids; ``file`` is the path.

    Spark's binary source holds one file in memory; larger ones are to be written in parts under 2 GB.
    """
    step = 2 * block
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length", "content")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.col("length"), F.lit(1)) - 1) / step))
    rows = files.select("file", "content", F.explode(blocks).alias("at"))
    return rows.select("file", "at", F.expr(f"substring(content, cast(at * {step} + 1 as int), {step})").alias("tokens"))


def separators(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, at, n, ends): each block's number of tokens and the places of its separators."""

    def run(batches):
        for batch in batches:
            flat = [np.frombuffer(t.as_py(), np.uint16) for t in batch.column("tokens")]
            ends = [np.flatnonzero(f == eod).astype(np.int32) for f in flat]
            places = pa.array(np.cumsum([0, *map(len, ends)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(places, pa.array(np.concatenate([*ends, np.zeros(0, np.int32)])))
            columns = [batch.column("file"), batch.column("at"), pa.array([len(f) for f in flat], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["file", "at", "n", "ends"])

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "at", "tokens").mapInArrow(run, f"file {kind}, at long, n long, ends array<int>")


def document_lengths(found: DataFrame) -> DataFrame:
    """(file, k, n_tokens): the k-th document of each file, from the blocks' separators."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    rows = rows.withColumn("last", F.when(F.size("ends") > 0, F.col("offset") + F.element_at("ends", -1)))
    rows = rows.withColumn("prev", F.coalesce(F.max("last").over(before), F.lit(-1)))
    # the stitch: each separator beside the one before it, the carried one at the front
    ends = F.transform("ends", lambda e: e + F.col("offset"))
    lasts = F.concat(F.array("prev"), ends)
    pairs = F.filter(F.arrays_zip(ends.alias("end"), lasts.alias("prev")), lambda x: x["end"].isNotNull())
    rows = rows.select("file", "first", F.posexplode(pairs).alias("i", "x"))
    return rows.select("file", (F.col("first") + F.col("i")).alias("k"), (F.col("x.end") - F.col("x.prev") - 1).alias("n_tokens"))


def _spelt(ids: np.ndarray) -> pa.Array:
    """doc_ids from rows of ``LEAD`` ids."""
    wide = ids.astype(np.uint64)
    name = wide[:, 0] | wide[:, 1] << np.uint64(15) | wide[:, 2] << np.uint64(30) | wide[:, 3] << np.uint64(45) | wide[:, 4] << np.uint64(60)
    return pa.array(name.view(np.int64), mask=ids[:, 4] >= 16)


def named_blocks(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, at, n, ends, ids, head, tail) of blocks of files whose documents are led by their ids.

    ``ids`` are the doc_ids of the documents that begin and end in the block; ``head`` are the first ids of the
    block, ``tail`` those behind its last separator, ``LEAD`` at most (tail is null in a later block without one).
    """

    def run(batches):
        for batch in batches:
            for file, at, tokens in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                flat = np.frombuffer(tokens.as_py(), "<u2")
                ends = np.flatnonzero(flat == eod)
                first = at.as_py() == 0
                starts = np.concatenate([[0] if first else [], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
                ids = _spelt(flat[starts[:, None] + np.arange(LEAD)]) if len(starts) else pa.array([], pa.int64())
                behind = ends[-1] + 1 if len(ends) else 0
                tail = flat[behind : behind + LEAD].tolist() if first or len(ends) else None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file.as_py()]), pa.array([at.as_py()], pa.int64()), pa.array([len(flat)], pa.int64()),
                        pa.array([ends.astype(np.int32)], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([flat[:LEAD].tolist()], pa.list_(pa.int32())), pa.array([tail], pa.list_(pa.int32())),
                    ],
                    ["file", "at", "n", "ends", "ids", "head", "tail"],
                )

    schema = "file string, at long, n long, ends array<int>, ids array<long>, head array<int>, tail array<int>"
    return blocks.select("file", "at", "tokens").mapInArrow(run, schema)


def named_lengths(found: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) from :func:`named_blocks`: a document that crosses blocks takes its id from where it began."""
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.withColumn("last", F.when(F.size("ends") > 0, F.col("offset") + F.element_at("ends", -1)))
    rows = rows.withColumn("begun", F.when(F.col("tail").isNotNull(), F.slice(F.concat("tail", F.coalesce(F.lead("head").over(order), F.array().cast("array<int>"))), 1, LEAD)))
    rows = rows.withColumn("prev", F.coalesce(F.max("last").over(before), F.lit(-1))).withColumn("begun", F.last("begun", True).over(before))
    rows = rows.where(F.size("ends") > 0)
    part = lambda k: F.shiftleft(F.get("begun", F.lit(k)).cast("long"), 15 * k)
    name = part(0)
    for k in range(1, LEAD):
        name = name.bitwiseOR(part(k))
    carried = F.when(F.get("begun", F.lit(LEAD - 1)) < 16, name)
    ids = F.when(F.col("at") == 0, F.col("ids")).otherwise(F.concat(F.array(carried), F.col("ids")))
    # the stitch: each separator beside the one before it, the carried one at the front
    ends = F.transform("ends", lambda e: e + F.col("offset"))
    lasts = F.slice(F.concat(F.array("prev"), ends), 1, F.size("ends"))
    rows = rows.select(F.explode(F.arrays_zip(ends.alias("end"), lasts.alias("prev"), ids.alias("doc_id"))).alias("x"))
    return rows.select("x.doc_id", (F.col("x.end") - F.col("x.prev") - 1 - LEAD).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str = TOKENIZER, block: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens), one row per row of ``docs``, by way of flat token files; ``block`` is ``LEAD`` ids at least."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_root(spark)}/flat-tokens-{uuid.uuid4().hex[:12]}"
    write_flat_files(token_lists(docs, path), folder)
    drop_at_exit(spark, folder)
    return named_lengths(named_blocks(read_flat_files(spark, folder, block)))


def token_lengths(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, length): tokens of each text, without files."""

    def run(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t.as_py() or "")) for t in batch.column(1)], pa.int64())], ["doc_id", "length"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, length long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
