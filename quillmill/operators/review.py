"""Human review: what is flagged, what was decided, and what a decision changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.sources.shared import ordinal


def numbered(log: DataFrame, *order: str) -> DataFrame:
    """``flag_id`` from 0 in an order given."""
    return ordinal(log, "flag_id", *order)


def by_type(log: DataFrame) -> DataFrame:
    """Flags per type, most first, with their share in percent and the first flag for ties."""
    counted = log.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("flag_id").alias("first_flag"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over a row per type
    return counted.select("entity_type", "n", F.round(100 * F.col("n") / total, 1).alias("pct"), "first_flag")


def by_file(log: DataFrame, top: int = 4, joiner: str = ": ") -> DataFrame:
    """Flags per file and its most frequent types as text."""
    each = log.groupBy("file", "entity_type").agg(F.count("*").alias("n"), F.min("flag_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "first"))
    ranked = each.withColumn("place", place)
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", F.concat("entity_type", F.lit(joiner), F.col("n").cast("string")).alias("s")))))
    return ranked.groupBy("file").agg(F.sum("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("types"))


def confidence_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"), F.avg("confidence").alias("mean"))


def matching(log: DataFrame, file: str | None = None, entity_type: str | None = None, search: str | None = None) -> DataFrame:
    """Parts of file names and whole types, in any case; ``search`` looks in file names and texts."""
    if file:
        log = log.where(F.contains(F.lower("file"), F.lit(file.lower())))
    if entity_type:
        log = log.where(F.upper("entity_type") == entity_type.upper())
    if search:
        low = F.lit(search.lower())
        log = log.where(F.contains(F.lower("file"), low) | F.contains(F.lower("original_text"), low))
    return log


def decide(log: DataFrame, decision: str, *, flag_id: int | None = None, entity_type: str | None = None, file: str | None = None, search: str | None = None) -> DataFrame:
    """Set ``decision`` for one flag, a type, a file, or all that a search shows."""
    hit = F.lit(True)
    if flag_id is not None:
        hit = hit & (F.col("flag_id") == flag_id)
    if entity_type is not None:
        hit = hit & (F.col("entity_type") == entity_type)
    if file is not None:
        hit = hit & (F.col("file") == file)
    if search is not None:
        low = F.lit(search.lower())
        hit = hit & (F.contains(F.lower("file"), low) | F.contains(F.lower("original_text"), low))
    return log.withColumn("decision", F.when(hit, decision).otherwise(F.col("decision")))


def restores(decision_col: str = "decision"):
    """Everything but "restore", in any case and with blanks around it, means approve."""
    return F.coalesce(F.lower(F.regexp_replace(decision_col, r"(?U)^\s+|\s+$", "")) == "restore", F.lit(False))


def exclusions(decisions: DataFrame) -> DataFrame:
    """``file, excluded``: the texts that stay as they were."""
    return decisions.where(restores()).groupBy("file").agg(F.array_sort(F.collect_set("original_text")).alias("excluded"))


def affected(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files to process again; all of the same name."""
    return files.join(excluded, files["original_filename"] == excluded["file"], "left_semi")


def patched_log(log: DataFrame, again: DataFrame, names: DataFrame) -> DataFrame:
    """The log without the files processed again, and their new flags."""
    return log.join(names, "file", "left_anti").unionByName(again)


def patched_records(records: DataFrame, new: DataFrame) -> DataFrame:
    """Fine-tuning records with the new values of ``new (source, text, metadata)`` where there are any."""
    renamed = new.select("source", F.col("text").alias("__text"), F.col("metadata").alias("__meta"))
    joined = records.withColumn("source", F.col("metadata.source")).join(renamed, "source", "left")
    return joined.select(F.coalesce("__text", "text").alias("text"), F.coalesce("__meta", "metadata").alias("metadata"))


def audit(decisions: DataFrame) -> DataFrame:
    hit = restores()
    return decisions.agg(
        F.count("*").alias("total_flags_reviewed"), F.count_if(~hit).alias("approved_keep_redacted"), F.count_if(hit).alias("restored_original")
    )


def counters(log: DataFrame) -> DataFrame:
    """Approved, restored and pending flags of a session; pending ones have no decision."""
    return log.agg(
        F.count_if(F.col("decision") == "approve").alias("approved"), F.count_if(F.col("decision") == "restore").alias("restored"),
        F.count_if(F.col("decision").isNull()).alias("pending"),
    )


def audit_entry(decisions: DataFrame, reviewer: str, stamp: str) -> DataFrame:
    """The counts of one review with who decided and when: an entry of the audit."""
    return audit(decisions).select(F.lit(stamp).alias("timestamp"), F.lit(reviewer).alias("reviewer"), "*")


def with_entry(manifest: DataFrame, entry: DataFrame, list_col: str = "human_reviews") -> DataFrame:
    """The manifest (one row) with one more struct at the end of its list of entries, which is made where it is missing."""
    one = entry.select(F.struct(*[F.col(c) for c in entry.columns]).alias("__entry"))
    kind = one.schema["__entry"].dataType.simpleString()
    old = F.col(list_col) if list_col in manifest.columns else F.lit(None).cast(f"array<{kind}>")
    tied = manifest.withColumn("__k", F.lit(0)).join(one.withColumn("__k", F.lit(0)), "__k", "left")
    grown = F.concat(F.coalesce(old, F.expr(f"cast(array() as array<{kind}>)")), F.array("__entry"))
    return tied.withColumn(list_col, grown).drop("__k", "__entry")
