"""The manifest: one row per file with what a sidecar says of it, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCR_REASON = "ocr_confidence_low"


def last_by_filename(sidecar: DataFrame, order_col: str) -> DataFrame:
    """Of several lines for a file the last one counts."""
    others = [c for c in sidecar.columns if c not in ("filename", order_col)]
    return sidecar.groupBy("filename").agg(F.max_by(F.struct(*others), order_col).alias("s")).select("filename", "s.*")


def provenance_files(results: DataFrame, sidecar: DataFrame) -> DataFrame:
    """``results (filename, path, sha256, ...)`` left-joined with the sidecar by file name; misses are empty."""
    info = sidecar.select("filename", "copyright_status", "source_url_or_collection", "notes")
    return results.join(info, "filename", "left").select(
        F.col("filename").alias("original_filename"), F.col("path").alias("source_path"), "sha256", "doc_type",
        F.bround("confidence", 3).alias("classification_confidence"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("copyright_status", "source_url_or_collection", "notes")], "skipped", "skip_reason",
        F.struct("ocr", F.bround("ocr_confidence", 1).alias("ocr_confidence"), "pii_stripped", "faker_substitutions", "review_flags", "chunk_count", "token_count").alias("processing"),
    )


def summary(files: DataFrame) -> DataFrame:
    """One row; counts by type and sums are of processed files only."""
    done = ~F.col("skipped")
    count = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")
    return files.agg(
        F.count("*").alias("total_files"), count(done).alias("processed_files"), count(F.col("skipped")).alias("skipped_files"),
        total("processing.token_count").alias("total_tokens"), *[count(done & (F.col("doc_type") == t)).alias(f"{t}_files") for t in ("caselaw", "published", "private", "uncertain")],
        count(done & F.col("processing.ocr")).alias("ocr_files"), count(F.col("skip_reason") == OCR_REASON).alias("review_queue_files"),
        total("processing.review_flags").alias("pii_review_flags"),
    )


def file_table(files: DataFrame) -> DataFrame:
    """With ``place``: the row's number by type and name written as one word."""
    key = F.concat("doc_type", "original_filename")
    return files.select("original_filename", "doc_type", "processing.token_count", "processing.review_flags", "processing.chunk_count", key.alias("sort_key"))
