"""Rankings and time series: hotspots, debt, churn, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hotspots(complexity: DataFrame, churn: DataFrame, top: int) -> DataFrame:
    """(file, complexity, churn, score): files with both over zero, by their product; the first ``top``."""
    both = complexity.where("complexity > 0").join(churn.where("churn > 0"), "file")
    score = F.col("complexity").cast("long") * F.col("churn").cast("long")
    return both.select("file", "complexity", "churn", score.alias("score")).orderBy(F.desc("score"), F.desc("complexity"), "file").limit(top)


def churn(commits: DataFrame, since: Column) -> DataFrame:
    """(file, churn): commits that touch each file from ``since`` on."""
    return commits.where(F.col("ts") >= since).groupBy("file").agg(F.count("*").alias("churn"))


def age_days(now: Column, then: Column) -> Column:
    """Whole days between two times, not negative; 0 if unknown."""
    return F.coalesce(F.greatest(F.lit(0), F.timestamp_diff("DAY", then, now)), F.lit(0)).cast("long")


def debt(baseline: DataFrame, introduced: DataFrame, churned: DataFrame, now: Column) -> DataFrame:
    """``baseline`` with age in days, churn and their product."""
    out = baseline.join(introduced, "fingerprint", "left").join(churned, "fingerprint", "left")
    out = out.withColumns({"age_days": age_days(now, F.col("introduced")), "churn": F.coalesce("churn", F.lit(0)).cast("long")})
    return out.withColumn("score", F.col("age_days") * F.col("churn"))


def ranked(debts: DataFrame, top: int) -> DataFrame:
    """The first ``top`` by score and age, then file and rule."""
    return debts.orderBy(F.desc("score"), F.desc("age_days"), "file", "rule_id").limit(top)


def over_age(ranked: DataFrame, days: int) -> DataFrame:
    return ranked.where(F.col("age_days") > days)


def trend(entries: DataFrame) -> DataFrame:
    """(snapshot, total, delta): entries of each snapshot and the change from the one before; the first has 0."""
    n = entries.groupBy("snapshot").agg(F.count("*").alias("total"))
    before = F.lag("total", 1).over(Window.partitionBy(F.lit(0)).orderBy("snapshot"))
    return n.withColumn("delta", F.col("total") - F.coalesce(before, F.col("total")))


def format_age(days: Column) -> Column:
    return F.when(days < 30, F.concat(days, F.lit("d"))).when(days < 365, F.concat(F.floor(days / 30), F.lit("mo"))).otherwise(F.concat(F.floor(days / 365), F.lit("y")))


def selected(revisions: DataFrame, limit: int = 20) -> DataFrame:
    """(revision, at, rule_id): entries of the newest ``limit`` revisions (revision, at, text: a baseline), all for 0.

    Revisions that can't be read are left out, not counted as empty; one without entries has a row without a rule.
    """
    read = revisions.select("revision", "at", F.from_json("text", "array<struct<ruleId: string>>").alias("entries"), F.trim("text").startswith("[").alias("_list")).where("entries is not null and _list")
    read = read.where(~F.exists("entries", lambda x: x.isNull()))
    newest = read.orderBy(F.desc("at"), F.desc("revision")).limit(limit) if limit else read
    return newest.select("revision", "at", F.explode_outer("entries").alias("x")).select("revision", "at", F.col("x.ruleId").alias("rule_id"))


def summarised(entries: DataFrame) -> DataFrame:
    """(revision, at, total, delta, by_rule): counts of each revision, the change from the one before, and a map by rule."""
    each = entries.groupBy("revision", "at", "rule_id").agg(F.count("rule_id").alias("n"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", "n"))))
    out = each.groupBy("revision", "at").agg(F.sum("n").alias("total"), F.map_from_entries(pairs).alias("by_rule"))
    before = F.lag("total", 1).over(Window.partitionBy(F.lit(0)).orderBy("at", "revision"))
    return out.select("revision", "at", "total", (F.col("total") - F.coalesce(before, F.col("total"))).alias("delta"), "by_rule")
