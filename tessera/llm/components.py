"""Connected components of an edge table, in rounds of large-star and small-star.

Every round is two exchanges of the remaining edges; rounds grow with the logarithm of the longest path. Each result is
written to the shared folder, so that a lost executor costs one round. Minima are taken before the exchange, and the
join that follows may split a hub's rows, so that no task gathers a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    out = both.join(low, F.col("a") == F.col("_a")).where("b > a")
    return out.select(F.col("b").alias("a"), F.least("a", "_m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    out = down.join(low, F.col("a") == F.col("_a"))
    pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b"))))
    return out.select(pairs.alias("x")).select("x.*").where("a <> b").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that isn't its component's smallest, and that smallest node. ``edges`` is written: a, b of one orderable type."""
    now = written(edges.where("a <> b").select("a", "b").distinct())
    before = _sum(now)
    while before[0]:
        now = written(_small(_large(now)))
        after = _sum(now)
        if after == before:
            break
        before = after
    return now
