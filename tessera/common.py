"""Saving intermediate tables where all executors find them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``.

    A folder is made only where the setting is missing and all tasks run in this process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: columns are pruned, filters pushed down."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Characters of text whose rows a task sorts. A character of code makes rows of about 50 to 120 bytes.
BUCKET_TEXT = 2_000_000


def buckets_of(files: DataFrame) -> int:
    """As many buckets as the session has partitions, and more for much text: what a task holds doesn't grow with the input."""
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = files.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(least, -(-text // BUCKET_TEXT)), max(least, 100_000))


def by_file(files: DataFrame, buckets: int | None = None) -> DataFrame:
    """``files`` (file_id, ...) dealt out as ``laid_out`` writes: what is made of a file stays in the file's task."""
    n = buckets or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.withColumn("file_id", F.col("file_id").cast("long")).repartition(n, "file_id")


def laid_out(df: DataFrame, *order: str, buckets: int | None = None) -> DataFrame:
    """``df`` (file_id, ...) as a table in buckets by file, sorted by file and ``order``.

    Joins on (file_id, ...), groups and windows of a file need no exchange of it. For joins that asks for one setting of
    the session: that equal buckets of file_id serve joins on more columns, too. Rows of ``by_file`` are where they
    belong and are not moved again.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"tessera_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", shared_path(spark)).bucketBy(buckets, "file_id").sortBy("file_id", *order).saveAsTable(name)
    return spark.table(name)
