"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import op1_simhash, op2_packing, op3_decontamination, op5_toxicity, op6_substring
from stratalens.llm.common import materialize, table

STAGES = [
    ("toxicity", op5_toxicity.stage),
    ("near_duplicates", op1_simhash.stage),
    ("substrings", op6_substring.stage),
    ("decontamination", op3_decontamination.stage),
    ("packing", op2_packing.stage),
]

#: Fingerprints, forests, automata and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
