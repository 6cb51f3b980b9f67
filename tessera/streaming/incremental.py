"""Which files have to be parsed again. ``store`` keeps the tables that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaid(files: DataFrame, unsaved: DataFrame) -> DataFrame:
    """``files`` with the texts of ``unsaved`` (the same columns) in place of theirs."""
    return files.join(unsaved.select("path"), "path", "left_anti").select(*files.columns).unionByName(unsaved.select(*files.columns))


def versions(files: DataFrame) -> DataFrame:
    return files.withColumn("version", F.xxhash64("path", "text"))


def delta(files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to parse, versions to drop). ``parsed``: the versions that have been parsed."""
    now = versions(files)
    known = parsed.select("version").distinct()
    return now.join(known, "version", "left_anti"), known.join(now.select("version"), "version", "left_anti")
