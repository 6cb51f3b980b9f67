"""Blame, changed lines and issue keys from what version control prints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blame(said: DataFrame) -> DataFrame:
    """``said`` (..., text: porcelain blame of one line) with hash, author, at, summary; null hash for lines not committed."""
    field = lambda name: F.nullif(F.regexp_extract("text", rf"(?m)^{name} (.*)$", 1), F.lit(""))
    found = F.nullif(F.regexp_extract("text", r"^([0-9a-f]{40})\b", 1), F.lit(""))
    known = found.isNotNull() & (found != "0" * 40)
    seconds = field("author-time").cast("long")
    return said.select("*", F.when(known, found).alias("hash"), F.when(known, field("author")).alias("author"), F.when(known, F.timestamp_seconds(seconds)).alias("at"), F.when(known, field("summary")).alias("summary"))


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(file, line): lines from 0 that a diff (file, text) adds or changes. Counts left out are 1, and 0 is a deletion."""
    heads = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@"), F.lit(0))).alias("head")
    each = diffs.select("file", heads)
    first = F.regexp_extract("head", r"\+([0-9]+)", 1).cast("long") - 1
    count = F.coalesce(F.nullif(F.regexp_extract("head", r"\+[0-9]+,([0-9]+)", 1), F.lit("")), F.lit("1")).cast("long")
    each = each.select("file", first.alias("first"), count.alias("n")).where("n > 0")
    return each.select("file", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("line")).distinct()


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose line is among ``changed`` (file, line)."""
    lines = changed.select(F.col("file").alias("_f"), F.col("line").alias("_l"))
    return findings.join(lines, (F.col("path") == F.col("_f")) & (F.col("line") == F.col("_l")), "left_semi")


def issue_key(text: Column, pattern: str) -> Column:
    """The first match; null without one, or for an expression that doesn't compile."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def issue_url(key: Column, template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{key}"), key)
