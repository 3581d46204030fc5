"""Tables written to the folder that driver and executors share.

A written table cuts the lineage and survives the loss of any executor. The folder is the
session's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kinfabric-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/kinfabric-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The folder goes when the driver's JVM ends. While the write runs, Spark is asked to drop the
    shuffle files of the query as soon as it is done, so disk use follows one step, not the sum.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned, once nothing that is still to run reads them."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm = table.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batches to ``rows``: texts are long, and workers hold a batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that name a row by its id and text; null ids and null texts have keys too."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(said.cast("binary")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
