"""From raw documents to token files: five stages, each by one of the training-text operators.

Quality rules drop documents, SimHash keeps one document of each near-duplicate group, decontamination drops what holds
benchmark passages, the mix takes sources to their target weights (documents are repeated or cut at words where it asks
for that), and the token stage writes ids and returns their digest. Every stage's result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_duplicates, quality_rules, token_output
from tessera.llm.common import table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", near_duplicates.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_output", token_output.stage),
]

#: SQL can't express the near-duplicate, decontamination and token stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
