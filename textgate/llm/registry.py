"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, fingerprints, grace_dedup, html_text, language_id, license_scan, mixing, packing, quality, token_counts
from .common import fold, read_table


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.groups(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("spans")


def op2_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.groups(read_table(spark, sf_dir, "documents"))


def packing_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), packing_files())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(quality.learnable(docs), quality.learnable(labels))
    found = quality.classify(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "source", "n_tokens", "weight", "epoch", "block", "position")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2), "doc_id", "text", "lang")
    found = language_id.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_grace_dedup": op2_grace_dedup,
    "op3_packing": op3_packing,
    "op4_html_text": op4_html_text,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_bagminhash": op9_bagminhash,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op2_grace_dedup": r"""
        WITH n AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]', '', 'g') AS bare
          FROM documents)
        SELECT doc_id,
          first_value(doc_id) OVER w AS keep_id,
          count(*) OVER (PARTITION BY bare) AS group_size,
          row_number() OVER w = 1 AS kept,
          sha256(bare) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)""",
}
