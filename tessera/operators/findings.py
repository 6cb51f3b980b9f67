"""What happens to raw findings: severities, order, fingerprints, suppression, baseline, gate, suggestions.

A finding is a row with ``file_id``, ``path``, ``rule_id``, ``message``, ``line`` (from 0), and later ``severity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities in rising order, and other spellings that settings may use.
SEVERITIES = ("off", "hint", "information", "warning", "error")
SPELLINGS = {"none": "off", "false": "off", "info": "information", "warn": "warning"}

MARKER = "lens-ignore"


def severity(text: Column) -> Column:
    """The canonical name of a spelled severity, or null."""
    low = F.lower(F.trim(text))
    out = F.when(low.isin(*SEVERITIES), low)
    for said, name in SPELLINGS.items():
        out = out.when(low == said, F.lit(name))
    return out


def rank(name: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), name) - 1


def effective_severities(rules: DataFrame, settings: DataFrame) -> DataFrame:
    """``rules`` (rule_id, category, default_severity, ...) with ``severity``: session over rule over category over default.

    ``settings``: (scope: session, rule or category; key; value). A value that isn't a severity counts for nothing.
    """
    said = settings.select("scope", F.lower("key").alias("key"), severity(F.col("value")).alias("value")).where("value is not null")
    out = rules
    for scope, key in (("session", "rule_id"), ("rule", "rule_id"), ("category", "category")):
        one = said.where(F.col("scope") == scope).groupBy("key").agg(F.max("value").alias(f"_{scope}")).withColumnRenamed("key", f"_key_{scope}")
        out = out.join(F.broadcast(one), F.lower(key) == F.col(f"_key_{scope}"), "left").drop(f"_key_{scope}")
    return out.withColumn("severity", F.coalesce("_session", "_rule", "_category", "default_severity")).drop("_session", "_rule", "_category")


def skipped(rules: DataFrame) -> DataFrame:
    """(rule_id, reason) of the rules that are off."""
    return rules.where("severity = 'off'").select("rule_id", F.lit("disabled by configuration").alias("reason"))


def stamped(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of known rules that are on, with their severity and category."""
    return findings.drop("severity", "category").join(rules.where("severity <> 'off'").select("rule_id", "severity", "category"), "rule_id")


def report_order() -> list[Column]:
    return [F.upper("path"), F.col("path"), F.col("line"), F.col("rule_id"), F.col("message")]


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def anchored(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``anchor``, their trimmed line. ``files``: file_id, text.

    Only files with findings are cut into lines, and only the lines asked for leave the row.
    """
    asked = findings.groupBy(F.col("file_id").alias("_f")).agg(F.collect_set("line").alias("_at"))
    parts = F.transform(F.array(F.split("text", "\n", -1)), lambda p: F.transform("_at", lambda i: F.struct(i.alias("_l"), trimmed(F.get(p, i)).alias("anchor"))))
    each = files.join(asked, F.col("file_id") == F.col("_f")).select("_f", F.explode(F.flatten(parts)).alias("x")).select("_f", "x.*")
    return findings.join(each, (F.col("file_id") == F.col("_f")) & (F.col("line") == F.col("_l")), "left").drop("_f", "_l")


def fingerprinted(findings: DataFrame) -> DataFrame:
    """Findings (with ``anchor``) with ``ordinal`` among equal ones, and a ``fingerprint`` that line shifts don't change."""
    out = findings.withColumn("anchor", F.coalesce("anchor", F.lit("")))
    alike = Window.partitionBy("rule_id", "path", "message", "anchor").orderBy("line", "file_id")
    out = out.withColumn("ordinal", F.row_number().over(alike) - 1)
    payload = F.concat_ws("\n", "rule_id", "path", "message", "anchor", F.col("ordinal").cast("string"))
    return out.withColumn("fingerprint", F.substring(F.sha2(payload, 256), 1, 16))


def suppressions(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """(file_id, line, rule_id): a null line holds for the file, a null rule for all; a marker covers its line and the next."""
    found = F.regexp_extract_all("text", F.lit(rf"(?i){marker}(?:-file)?(?:\s*\[[^\]]*\])?"), F.lit(0))
    each = lines.select("file_id", "line", F.explode(found).alias("m"))
    whole = F.lower("m").startswith(f"{marker}-file")
    ids = F.array_remove(F.split(F.regexp_extract("m", r"\[([^\]]*)\]", 1), "[,; ]+"), "")
    each = each.select("file_id", F.when(~whole, F.col("line")).alias("line"), F.when(F.size(ids) > 0, ids).alias("ids"))
    each = each.select("file_id", "line", F.explode_outer("ids").alias("rule_id"))
    at = F.explode(F.when(F.col("line").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array(F.col("line"), F.col("line") + 1)))
    return each.select("file_id", at.alias("line"), F.upper("rule_id").alias("rule_id")).distinct()


def unsuppressed(findings: DataFrame, index: DataFrame) -> DataFrame:
    """Findings that no marker covers: markers become a row for each file and one for each line, joined once each."""
    said = (F.max(F.col("rule_id").isNull()).alias("_all"), F.collect_set("rule_id").alias("_ids"))
    hidden = F.coalesce(F.col("_all") | F.array_contains("_ids", F.upper("rule_id")), F.lit(False))
    whole = index.where("line is null").groupBy(F.col("file_id").alias("_f")).agg(*said)
    out = findings.join(whole, F.col("file_id") == F.col("_f"), "left").where(~hidden).drop("_f", "_all", "_ids")
    lines = index.where("line is not null").groupBy(F.col("file_id").alias("_f"), F.col("line").alias("_l")).agg(*said)
    return out.join(lines, (F.col("file_id") == F.col("_f")) & (F.col("line") == F.col("_l")), "left").where(~hidden).drop("_f", "_l", "_all", "_ids")


def split_by_baseline(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reportable, baselined) by fingerprint, whatever its case."""
    known = baseline.select(F.lower("fingerprint").alias("_k")).distinct()
    on = F.lower("fingerprint") == F.col("_k")
    return findings.join(known, on, "left_anti"), findings.join(known, on, "left_semi")


def at_least(findings: DataFrame, least: str) -> DataFrame:
    return findings.where(rank(F.col("severity")) >= SEVERITIES.index(least))


#: Words up to this length are found by what is left of them, longer ones by pieces.
SHORT = 24


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def leavings(word: Column, most: int) -> Column:
    """The word and all that deleting up to ``most`` of its letters leaves. Two words within ``most`` edits share one."""
    out = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.when(F.length(w) > 0, _without_one(w)).otherwise(F.array().cast("array<string>")))))
        out = F.array_union(out, last)
    return out


def pieces(word: Column, most: int) -> Column:
    """(n, k, piece): a word of ``n`` letters cut into ``most + 1`` pieces, one of which ``most`` edits leave whole."""
    n = F.length(word)
    cut = lambda k: F.floor(n * k / (most + 1)).cast("int")
    return F.array(*(F.struct(n.alias("n"), F.lit(k).alias("k"), F.substring(word, cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")) for k in range(most + 1)))


def places(word: Column, most: int) -> Column:
    """(n, k, piece): where a word within ``most`` edits, of ``n`` letters, may have its pieces in this one."""
    out = []
    for by in range(-most, most + 1):
        n = F.length(word) + by
        cut = lambda k, n=n: F.floor(n * k / (most + 1)).cast("int")
        for k in range(most + 1):
            for shift in range(-most, most + 1):
                first = cut(k) + 1 + shift
                piece = F.when((n > 0) & (first >= 1), F.substring(word, first, cut(k + 1) - cut(k)))
                out.append(F.struct(n.alias("n"), F.lit(k).alias("k"), piece.alias("piece")))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.piece.isNotNull()))


def near_words(unknown: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion): pairs that may be within ``most`` edits, whatever their case; all that are, and few others.

    Words share a leaving, or a piece at about its place if the known one is long. Both are keys of an equi-join.
    """
    mine, other = unknown.select("word", F.lower("word").alias("_w")), known.select(F.col("word").alias("suggestion"), F.lower("word").alias("_s"))
    short = mine.where(F.length("_w") <= SHORT + most).select("word", F.explode(leavings(F.col("_w"), most)).alias("left"))
    held = other.where(F.length("_s") <= SHORT).select("suggestion", F.explode(leavings(F.col("_s"), most)).alias("left"))
    long = mine.where(F.length("_w") > SHORT - most).select("word", F.explode(places(F.col("_w"), most)).alias("x")).select("word", "x.*")
    cut = other.where(F.length("_s") > SHORT).select("suggestion", F.explode(pieces(F.col("_s"), most)).alias("x")).select("suggestion", "x.*")
    return short.join(held, "left").select("word", "suggestion").union(long.join(cut, ["n", "k", "piece"]).select("word", "suggestion")).distinct()


def suggestions(unknown: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion, distance): the nearest known word within ``most`` edits, the first in the alphabet on ties."""
    pairs = near_words(unknown, known, most).withColumn("distance", F.levenshtein(F.lower("word"), F.lower("suggestion"), most)).where("distance >= 0")
    best = F.min(F.struct("distance", F.lower("suggestion").alias("low"), "suggestion")).alias("b")
    return pairs.groupBy("word").agg(best).select("word", "b.suggestion", F.col("b.distance").cast("long").alias("distance"))
