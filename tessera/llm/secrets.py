"""Secret scan over a trigram inverted index, by DataFrame functions alone.

1. Each rule's expression gives a Boolean trigram query (``trigrams``). A rule without mandatory trigrams scans all
   texts.
2. Index: one scan finds which of the queries' trigrams a text holds and posts its key under each; the lists are written.
   A posting list is cut into buckets of keys, so that no list, however common its trigram, is in one place.
3. The lists of each conjunction are intersected inside a bucket, shortest first; the union over a rule's conjunctions
   is its candidates.
4. Candidates are verified with the expression itself. Their keys are broadcast if that is small, else joined.
   Positions come from the lengths of matches and of the pieces between them, summed in a window over one document.

Cases: a null text counts as empty and has no spans. A null ``doc_id`` is a key like any other. Repeated rows each get
the same result. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import trigrams
from tessera.llm.common import let, small, table, written

#: Keys in a bucket of posting lists, about.
BUCKET = 4096


@dataclass(frozen=True)
class Rule:
    """``least``: the shortest value of group ``group`` that counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either(x).replace("_", "_?") for x in ("password", "passwd", "secret", "token", "api_key"))

#: The kinds that the contract settles. Runs of a set length or more are the runs of that length among all.
BASE = (
    Rule("assign", rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)

#: Further kinds.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", "AIza[0-9A-Za-z_-]{35,}"),
)

RULES = (*BASE, *MORE)


def row_key() -> Column:
    """Tells rows apart together with ``doc_id``."""
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    """Posting lists (term, bucket, keys) of the given trigrams over ``docs`` (key, text)."""
    held = let(F.lower("text"), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(terms)))))
    # written before it is read for its items: a filter on it would be pushed below and test all terms again
    posts = written(docs.select("key", held.alias("held"))).select("key", F.explode("held").alias("term"))
    return written(posts.groupBy("term", F.pmod("key", F.lit(buckets)).alias("bucket")).agg(F.collect_set("key").alias("keys")))


def candidates(docs: DataFrame, rules: list[tuple[int, trigrams.Query]]) -> DataFrame:
    """(rule, key) of the rows of ``docs`` (key, text) that meet a rule's trigram query."""
    terms = sorted({t for _, q in rules for conj in q for t in conj})
    asked = [(r, c, terms.index(t), len(conj)) for r, q in rules for c, conj in enumerate(q) for t in sorted(conj)]
    buckets = docs.count() // BUCKET + 1
    of = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("rule", "conj", "term", "n"), row, strict=True))) for row in asked)))
    wanted = docs.sparkSession.range(1).select(of.alias("x")).select("x.*")
    lists = index(docs, terms, buckets).join(F.broadcast(wanted), "term")
    held = F.array_sort(F.collect_list(F.struct(F.size("keys").alias("size"), "keys")))
    met = lists.groupBy("rule", "conj", "bucket", "n").agg(held.alias("held")).where(F.size("held") == F.col("n"))
    common = F.aggregate(F.slice("held", 2, F.size("held")), F.col("held")[0]["keys"], lambda a, x: F.array_intersect(a, x["keys"]))
    return met.select("rule", F.explode(common).alias("key")).distinct()


def spans(docs: DataFrame, rule: Rule, nth: int) -> DataFrame:
    """(doc_id, key, nth, kind, start, end) of a rule's matches in ``docs`` (doc_id, key, text); end exclusive, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    value = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else found
    pieces = F.split("text", rule.pattern, -1)
    hits = docs.where(F.col("text").rlike(rule.pattern)).select("doc_id", "key", F.arrays_zip(found.alias("found"), value.alias("value"), pieces.alias("piece")).alias("all"))
    hits = hits.select("doc_id", "key", F.posexplode("all").alias("at", "x")).where(F.col("x.found").isNotNull())
    hits = hits.select("doc_id", "key", "at", *(F.length(f"x.{c}").alias(c) for c in ("found", "value", "piece"))).distinct()
    order = Window.partitionBy("doc_id", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("found") + F.col("piece")).over(order)
    hits = hits.withColumn("end", end).where(F.col("value") >= rule.least)
    return hits.select("doc_id", "key", F.lit(nth).alias("nth"), F.lit(rule.kind).alias("kind"), (F.col("end") - F.col("found")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of all rules in ``docs`` (doc_id, text); equal rows give theirs once. Columns as ``spans``."""
    keyed = docs.select("doc_id", row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    queries = [(i, trigrams.query(r.pattern)) for i, r in enumerate(rules)]
    indexed = [(i, q) for i, q in queries if q != trigrams.ANY]
    out = [spans(keyed, rules[i], i) for i, q in queries if q == trigrams.ANY]
    if indexed:
        by_key = written(candidates(keyed, indexed).groupBy(F.col("key").alias("_key")).agg(F.collect_set("rule").alias("asked")))
        near = written(keyed.join(small(by_key), F.col("key") == F.col("_key")).drop("_key"))
        out += [spans(near.where(F.array_contains("asked", i)).drop("asked"), rules[i], i) for i, _ in indexed]
    all_of = out[0]
    for x in out[1:]:
        all_of = all_of.unionByName(x)
    return all_of


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    row = F.struct("start", "nth", "end", "kind")
    found = scan(docs).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(row)).alias("all"))
    keys = docs.select("doc_id", row_key().alias("key"))
    out = keys.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    out = out.withColumn("all", F.coalesce("all", F.array().cast(found.schema["all"].dataType)))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("all", lambda x: x["nth"] < len(BASE))
    number = lambda i: F.size(F.filter("all", lambda x: x["nth"] == i)).cast("long")
    counts = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))
