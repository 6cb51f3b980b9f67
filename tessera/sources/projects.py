"""Project files and snippets of documentation as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import directory


def parsed(projects: DataFrame) -> DataFrame:
    """(path, targets, error) of project files (path, text): what their ProjectReference elements include."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets, errors = [], []
            for text in batch.column("text").to_pylist():
                try:
                    root = ElementTree.fromstring((text or "").lstrip("\ufeff").strip())
                except (ElementTree.ParseError, ValueError) as e:
                    targets.append([]), errors.append(str(e))
                    continue
                found = [x.get("Include") for x in root.iter() if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == "ProjectReference"]
                targets.append([x for x in found if x and x.strip()]), errors.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(targets, pa.list_(pa.string())), pa.array(errors, pa.string())], names=["path", "targets", "error"])

    return projects.select("path", "text").mapInArrow(run, "path string, targets array<string>, error string")


def references(read: DataFrame) -> DataFrame:
    """(project, target): paths of project files and of what they refer to; ``read``: as from ``parsed``."""
    each = read.select(F.col("path").alias("project"), F.explode("targets").alias("target")).distinct()
    joined = F.concat_ws("/", directory(F.col("project")), F.replace("target", F.lit("\\"), F.lit("/")))
    return each.select("project", resolved(joined).alias("target"))


def resolved(path):
    """A path without ``.`` and ``..`` parts."""
    parts = F.split(path, "/")
    out = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    return F.array_join(out, "/")


def snippets(files: DataFrame) -> DataFrame:
    """(file_id, snippet_id, title, ordinal, language, text): fenced blocks of markdown under their ``### ID · Title`` headings."""
    lines = files.select("file_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    order = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(r"^\s*```")
    heading = F.when(F.col("text").rlike(r"^###\s+\S+\s+·\s+"), F.col("text"))
    out = lines.withColumns({"head": F.last(heading, ignorenulls=True).over(order), "fences": F.sum(fence.cast("int")).over(order)})
    opening = F.when(fence & (F.col("fences") % 2 == 1), F.regexp_extract("text", r"^\s*```\s*(\S*)", 1))
    out = out.withColumn("language", F.last(opening, ignorenulls=True).over(order)).where((F.col("fences") % 2 == 1) & ~fence & F.col("head").isNotNull())
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    blocks = out.groupBy("file_id", "head", "fences", "language").agg(body.alias("text"))
    nth = F.row_number().over(Window.partitionBy("file_id", "head").orderBy("fences")) - 1
    return blocks.select("file_id", F.regexp_extract("head", r"^###\s+(\S+)", 1).alias("snippet_id"), F.regexp_extract("head", r"·\s+(.*)$", 1).alias("title"), nth.alias("ordinal"), "language", "text")


#: What a snippet may be, and the text around it that makes it a whole file.
SHAPES = {"Unit": ("", ""), "Member": ("class Snippet {\n", "\n}"), "Statements": ("class Snippet { void Body() {\n", "\n} }")}


def shape_of(text: str) -> str:
    """Unit, Member or Statements: the first way of wrapping that leaves no stray tokens; else Unparseable."""
    from tessera.parse import csharp

    for shape, (head, tail) in SHAPES.items():
        root = csharp.parse(head + text + tail)
        stack, kinds = [root], []
        while stack:
            n = stack.pop()
            kinds.append(n.kind)
            stack += n.children
        types = [c for c in root.children if c.kind in ("Type", "Namespace", "Using")]
        whole = bool(types) and "Skipped" not in kinds and "Error" not in kinds
        if shape == "Unit" and whole and len(types) == len(root.children):
            return shape
        if shape == "Member" and whole and any(c.kind in ("Method", "Constructor", "Property", "Field", "Type", "Event", "Indexer") for t in types for c in t.children) and not re.match(r"\s*(?:var|return|if|for|foreach|while|using|await|try|throw)\b", text):
            return shape
        if shape == "Statements" and whole and text.strip() and text.count("{") == text.count("}") and text.count("(") == text.count(")"):
            return shape
    return "Unparseable"


def shapes(blocks: DataFrame) -> DataFrame:
    """``blocks`` (snippet_id, ordinal, text, ...) with ``shape``, in Arrow batches."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(shape_of)

    return blocks.withColumn("shape", of(F.col("text")))
