"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, op10_fingerprints, op11_secrets, op12_divergence, op13_tries, op1_simhash, op2_packing, op3_decontamination, op4_html, op5_toxicity, op6_substring, op7_licenses, op8_suffixes, op9_token_files


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_fingerprints that SQL can express."""
    return op10_fingerprints.op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash.op1_simhash_dedup,
        "op2_packing": op2_packing.op2_packing,
        "op3_decontamination": op3_decontamination.op3_decontamination,
        "op4_html_text": op4_html.op4_html_text,
        "op5_toxicity": op5_toxicity.op5_toxicity,
        "op6_substring_dedup": op6_substring.op6_substring_dedup,
        "op7_license_scan": op7_licenses.op7_license_scan,
        "op8_suffix_dedup": op8_suffixes.op8_suffix_dedup,
        "op9_token_files": op9_token_files.op9_token_files,
        "op10_fingerprints": op10_fingerprints.op10_fingerprints,
        "edited_texts": edited_texts,
        "op11_secret_scan": op11_secrets.op11_secret_scan,
        "secret_spans": op11_secrets.secret_spans,
        "op12_divergence": op12_divergence.op12_divergence,
        "op13_prefix_trie": op13_tries.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
