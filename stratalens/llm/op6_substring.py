"""Operator 6, substring dedup by fixed-block anchors.

Half-window reference blocks are indexed one after another; every rolling
half-window probes them; hits are extended to whole windows and, through
overlapping windows, to maximal exact repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clash_free, table
from .repeats import WordWindows, cut_repeats


def dedup_substrings(docs: DataFrame, window: int = 20, *, id_column: str = "doc_id", text_column: str = "text", columns: list[str] | None = None, with_kept: bool = False) -> DataFrame:
    """Remove each word covered by a window of words that also starts earlier.

    Words are runs of bytes that aren't ASCII white space.  Earlier: smaller
    id, or the same document and an earlier start.  Texts shorter than a
    window, empty and null ones lose nothing; an empty table gives an empty
    result.  Null ids come last; two texts under one id are ordered by hash;
    rows equal in id and text are one document.  Columns: ``columns``, n_words,
    n_removed, n_spans, kept_sha256 and, if asked for, kept.
    """
    return cut_repeats(docs, WordWindows(window), id_column=id_column, text_column=text_column, columns=columns, with_kept=with_kept).withColumnRenamed("n", "n_words")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@clash_free
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated words cut; a text of which nothing is left stays, empty."""
    out = dedup_substrings(docs, columns=docs.columns, with_kept=True)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
