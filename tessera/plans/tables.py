"""The driver's tables in the shapes that the operators take.

Documents are files (``source/lang/doc_id``), pages are files under the path of their URL with hosts as projects, events
are commits (user = file, type = rule), orders are accepted findings, and a call edge goes from a customer's nation to a
supplier's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return p.select(F.col("page_id").alias("file_id"), plain.alias("path"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "html")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("commit"), "ts", F.col("user_id").alias("file"), F.col("event_type").alias("rule_id"), "value", "props")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for every line item: callee is the supplier's nation, caller the customer's."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("caller"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("callee"))
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).select("callee", "caller")


#: Edges and shapes in SQL.
EDGES = """edges AS (SELECT CAST(s_nationkey AS BIGINT) AS callee, CAST(c_nationkey AS BIGINT) AS caller
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
FILES = "files AS (SELECT doc_id AS file_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, lang, source, coalesce(text, '') AS text FROM documents)"
LINES = FILES + """, lines AS (SELECT file_id, path, CAST(i - 1 AS BIGINT) AS line, parts[i] AS text
  FROM (SELECT file_id, path, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files))"""
PAGES = """p AS (SELECT page_id AS file_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path,
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, html FROM pages)"""
