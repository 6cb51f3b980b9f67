"""Shared helpers: scratch tables in the cluster's shared folder, word splitting, let-binding."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset and all tasks run in this process (local mode, tests) a
    folder is made and set; executors of a cluster would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def written(df: DataFrame, *sort: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables of which all that was asked has been written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words ``[^ \\t-\\r]+`` of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its size is known to be at most ``limit`` bytes, else as it is.

    ``df`` has to be a written table (see ``written``), for which Spark's statistics give the size of the files. Files
    are compressed, so that the rows (which the footers tell) count at 16 bytes a column at least.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= limit and 16 * len(df.columns) * df.count() <= limit:
        return F.broadcast(df)
    return df


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of theirs can clash with one of ours."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns))
