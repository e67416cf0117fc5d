"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import exact_dedup, language_id, licenses, media, near_dedup, packing, rank_bpe, suffix_dedup, token_counts, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_length_histogram": lambda s, d: token_counts.length_histogram(token_counts.token_lengths(_documents(s, d))),
    "op2_jpeg_media": lambda s, d: media.stored_features(_documents(s, d)),
    "op3_language_id": lambda s, d: language_id.identify_languages(_documents(s, d)),
    "op4_license_scan": lambda s, d: licenses.scan_licenses(_documents(s, d)),
    "op5_token_files": lambda s, d: token_files.token_files(_documents(s, d)),
    "op6_packing": lambda s, d: packing.pack_documents(_documents(s, d)),
    "op7_suffix_dedup": lambda s, d: suffix_dedup.remove_repeats(_documents(s, d)),
    "op8_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(_documents(s, d)),
    "op9_rank_bpe": lambda s, d: rank_bpe.encoding_digests(_documents(s, d)),
    "op10_near_dedup": lambda s, d: near_dedup.near_duplicates(_documents(s, d)),
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
