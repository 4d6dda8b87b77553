"""Operator 8, suffix-array dedup.

Buckets of q-grams are kept from bucket-pointer refinement; their sorting is
replaced by hashes of windows, so no suffix is sorted (see repeats.ByteStrings
and the README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import ByteStrings, cut_repeats


def dedup_suffixes(docs: DataFrame, length: int = 400, *, id_column: str = "doc_id", text_column: str = "text", columns: list[str] | None = None, with_kept: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts elsewhere.

    Occurrences overlap freely and never cross documents; all of them go.
    Texts shorter than ``length``, empty and null ones lose nothing.  Rows
    equal in id and text are one document, not copies.  Columns: ``columns``,
    n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept.
    """
    return cut_repeats(docs, ByteStrings(length), id_column=id_column, text_column=text_column, columns=columns, with_kept=with_kept).withColumnRenamed("n", "n_bytes")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
