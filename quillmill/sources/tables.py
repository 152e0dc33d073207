"""Logs, decisions, lists and manifests, with their schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.targets import FALLBACK, strip
from quillmill.sources import snapshots
from quillmill.sources.snapshots import exists

SIDECAR = "filename string, copyright_status string, source_url_or_collection string, notes string"
DECISIONS = "flag_id int, file string, entity_type string, original_text string, confidence double, decision string"
FLAGS = "file string, entity_type string, original_text string, confidence double, context string, action string"
FINETUNE = "text string, metadata struct<source:string,doc_type:string,pii_stripped:boolean,faker_substitutions:int,review_flags:int,token_count:int>"
RAG = (
    "id string, text string, metadata struct<source:string,doc_type:string,chunk_index:int,total_chunks:int,token_count:int,"
    "citation string,year int,court string,ocr boolean>"
).replace("citation string", "citation:string").replace("year int", "year:int").replace("court string", "court:string").replace("ocr boolean", "ocr:boolean")
MANIFEST = (
    "dataset_name string, version string, created string, created_by string, source_collection string, license string,"
    " jurisdiction_coverage array<string>, notes string, source_dir string"
)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; quotes inside quotes are doubled and fields may hold line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).schema(schema).csv(path)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, SIDECAR).fillna("")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, DECISIONS)


def jsonl(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped; ``file`` names where each came from unless the schema has it.

    Of a folder with versions, the latest or the one that is named.
    """
    rows = snapshots.scan(spark, path, schema, version)
    return rows if "file" in rows.columns else rows.withColumn("file", F.col("_metadata.file_path"))


def review_log(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, FLAGS)


def finetune(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, FINETUNE)


def rag(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, RAG)


def parse_blocklist(lines: DataFrame) -> DataFrame:
    """``value, token`` of lines ``value[TAB token]``; comments and blank lines are skipped."""
    line = strip(F.col("value"))
    kept = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    cut = F.split("line", "\t", 2)
    return kept.select(strip(cut[0]).alias("value"), F.when(F.size(cut) > 1, strip(F.get(cut, F.lit(1)))).otherwise(FALLBACK).alias("token")).where("value != ''")


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocklist(spark.read.text(path))


def manifest(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """One row; where the file is absent, one of nulls, or an error if it is ``required``."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([tuple([None] * len(MANIFEST.split(", ")))], MANIFEST)
    return spark.read.option("multiLine", True).schema(MANIFEST).json(path)


FILES = (
    "original_filename string, source_path string, sha256 string, doc_type string, classification_confidence double, date_processed string, copyright_status string, source_url_or_collection string, notes string,"
    " skipped boolean, skip_reason string, processing struct<ocr:boolean,ocr_confidence:double,pii_stripped:boolean,faker_substitutions:int,review_flags:int,chunk_count:int,token_count:int>"
)
ASSESSMENTS = (
    "pos int, source string, risk_level string, raw_response string, assessment struct<quasi_identifiers:array<struct<type:string,value:string,concern:string>>,additional_redactions:array<string>>"
)


def manifest_files(spark: SparkSession, output: str) -> DataFrame:
    """The files of a run's manifest, which has to be there."""
    if not exists(spark, f"{output}/manifest/files"):
        raise FileNotFoundError(f"{output}/manifest/files")
    return spark.read.schema(FILES).json(f"{output}/manifest/files")


def assessments(spark: SparkSession, path: str) -> DataFrame:
    """``pos, source, risk_level, quasi_identifiers, additional_redactions`` of a risk report."""
    return spark.read.schema(ASSESSMENTS).json(path).select("pos", "source", "risk_level", "assessment.quasi_identifiers", "assessment.additional_redactions")
