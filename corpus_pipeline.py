"""The training-data pipeline: quality, near-duplicates, repeated passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bagminhash, packing, pii, quality, substrings
from quillmill.llm.queries import PII_KEY, public
from quillmill.llm.shared import materialize, read, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.quality(docs, read(spark, sf_dir, "labels")).where("q_keep").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays, that with the least id.

    A row goes by its id and its text, so rows of one id with other texts are judged by their own, also where that id is
    the least of several classes; of equal rows one stays. Rows without an id or without words are no copies and stay. Only the columns
    of ``documents`` do.
    """
    rows = bagminhash.near_duplicates(docs).where("n > 0 and id is not null")
    stays = (F.col("id") == F.col("class_id")) & (F.col("h") == F.col("class_h"))
    each = rows.groupBy(F.col("id").alias("doc_id"), F.col("h").alias("__h")).agg(F.first(stays).alias("stays"), F.count("*").alias("rows"))
    each = materialize(each.where("not stays or rows > 1"), "classes")
    key = ["doc_id", "__h"]
    kept = docs.withColumn("__h", F.xxhash64("text")).select(*COLUMNS, "__h").join(each.where("not stays").select(*key), key, "left_anti")
    twice = each.where("stays").select(*key)
    if not twice.isEmpty():
        one = kept.join(twice, key, "left_semi").dropDuplicates(key)
        kept = kept.join(twice, key, "left_anti").unionByName(one)
    return kept.select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier go; a document without such words keeps its text as it is."""
    cut = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    fixed = pii.replace_pii(docs, PII_KEY, count_col=None)
    return fixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with the checksum of their ids."""
    pieces = packing.pack(docs, public("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A trained classifier, signatures and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
