"""Whole runs over a folder: process it, review it, assess and redact a second time. Each takes what its command line takes.

An output folder holds ``rag``, ``finetune``, ``review/log``, ``review/csv``, ``review/ocr_queue``, ``review/decisions-<time>``,
``manifest/files``, ``manifest/summary``, ``audit`` and ``risk``. A review and a second pass change ``finetune``, ``rag`` and
``review/log`` by new versions (:mod:`quillmill.sources.snapshots`): only files whose rows change are written anew, older
versions stay readable, and no run reads what it writes.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import chunks
from quillmill.operators import dedup, process, provenance, review, risk, second_pass
from quillmill.sources import files, sinks, snapshots, tables
from quillmill.sources.shared import written


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def process_folder(spark: SparkSession, source: str, output: str, dry_run: bool = False, sidecar: str | None = None, adapter=None, count=chunks.word_tokens, **readers) -> DataFrame:
    """The results of all files, the skipped ones too; unless ``dry_run``, everything is written to ``output``.

    ``readers``: adapters for PDF, Outlook mail and scans as :func:`quillmill.sources.files.read` takes them.
    ``adapter``: further spans, as :func:`quillmill.operators.process.detected` takes them. ``count``: the tokenizer of the chunks.
    Bytes are read twice: once for the hashes, which are kept, and once for the texts of the best versions.
    """
    found = files.scan(spark, source)
    hashes = written(found.drop("content"), "hashes")
    best = dedup.best_versions(hashes).select("path")
    docs = files.read(found.join(best, "path", "left_semi"), **readers).withColumn("doc_id", F.xxhash64("path"))
    done = process.processed(docs.where("not skipped"), adapter, count)
    if not dry_run:
        docs = written(docs, "texts")
        done = written(process.processed(docs.where("not skipped"), adapter, count), "processed")
    results = process.results(done).unionByName(process.skipped_results(docs.where("skipped")))
    if dry_run:
        return results
    sinks.write_rag(process.rag_records(done), f"{output}/rag")
    sinks.write_finetune(process.finetune_records(done), f"{output}/finetune")
    flags = written(review.numbered(process.review_log(done), "doc_id", "pos"), "flags")
    if not flags.isEmpty():
        sinks.write_review_log(flags, f"{output}/review/log")
        sinks.write_csv(sinks.review_csv(flags), f"{output}/review/csv")
    low = docs.where(F.col("skip_reason") == provenance.OCR_REASON).select("path")
    sinks.write_ocr_queue(found.join(low, "path", "left_semi"), f"{output}/review/ocr_queue")
    side = tables.sidecar(spark, sidecar) if sidecar else spark.createDataFrame([], tables.SIDECAR)
    manifest = written(provenance.provenance_files(results.join(hashes.select("path", "sha256"), "path"), side).withColumn("date_processed", F.lit(now())), "manifest")
    sinks.write_manifest({"created": now()[:10], "source_dir": source}, manifest, provenance.summary(manifest), f"{output}/manifest")
    return results


def apply_decisions(spark: SparkSession, output: str, decisions: str, reviewer: str = "", adapter=None, **readers) -> DataFrame:
    """Archive the decisions, process the files with restored texts again, and put an entry into the audit; returns that entry."""
    stamp = now()
    rows = written(tables.decisions(spark, decisions), "decisions")
    sinks.archive_decisions(rows, f"{output}/review", stamp)
    manifest = tables.manifest_files(spark, output)
    excluded = review.exclusions(rows)
    again = review.affected(manifest, excluded).select(F.col("source_path").alias("path"))
    paths = [r["path"] for r in again.collect()]  # what one review restored
    if paths:
        docs = files.read(files.scan(spark, paths), **readers).withColumn("doc_id", F.xxhash64("path")).where("not skipped")
        rows_again = process.detected(process.cleaned(process.classified(docs)), adapter).join(excluded.withColumnRenamed("file", "filename"), "filename")
        done = written(process.chunked(process.redacted(rows_again, excluded_col="excluded")), "again")
        new = process.finetune_records(done).select(F.col("metadata.source").alias("source"), "text", "metadata")
        patch_records(spark, f"{output}/finetune", new)
        patch_log(spark, f"{output}/review/log", process.review_log(done).drop("doc_id", "pos"), excluded)
    entry = review.audit_entry(rows, reviewer, stamp).withColumn("files_reprocessed", F.lit(len(paths)))
    sinks.append_audit(entry, f"{output}/audit/human_reviews")
    return entry


def patch_records(spark: SparkSession, folder: str, new: DataFrame) -> int:
    """The new values of ``new (source, text, metadata)`` in the files that hold those sources; the number of files written anew."""
    base = snapshots.latest(spark, folder)
    old = snapshots.paths(snapshots.scan(spark, folder, tables.FINETUNE, base)).withColumn("source", F.col("metadata.source"))
    hit = snapshots.touched(old.join(new.select("source"), "source", "left_semi"))
    if hit:
        rows = snapshots.scan(spark, folder, tables.FINETUNE, base, hit)
        snapshots.replaced(spark, folder, base, hit, review.patched_records(rows, new))
    return len(hit)


def patch_log(spark: SparkSession, folder: str, again: DataFrame, names: DataFrame) -> int:
    """The flags of documents processed again in place of their old ones; the number of files written anew. Nothing where no log is."""
    if not tables.exists(spark, folder):
        return 0
    base = snapshots.latest(spark, folder)
    old = snapshots.paths(snapshots.scan(spark, folder, tables.FLAGS, base))
    hit = snapshots.touched(old.join(names, "file", "left_semi"))
    rows = snapshots.scan(spark, folder, tables.FLAGS, base, hit)
    snapshots.replaced(spark, folder, base, hit, review.patched_log(rows, again, names))
    return len(hit)


def assess(spark: SparkSession, output: str, assessor, samples: int = 0, model: str = "") -> DataFrame:
    """Assess the records of most flags first and write the report; ``assessor`` adds a column ``response``."""
    from quillmill.sources.shared import ordinal

    records = ordinal(tables.finetune(spark, f"{output}/finetune").drop("file"), "line_no", F.col("metadata.source"), "text")
    chosen = risk.prioritised(records, samples)
    done = written(risk.assessed(chosen, assessor).withColumn("pos", F.col("line_no")).withColumn("source", F.col("metadata.source")), "assessed")
    sinks.write_risk_report(risk.report(done, records.count(), model, now()), done.drop("text", "sample"), f"{output}/risk")
    return done


def second_pass_run(spark: SparkSession, output: str, assessments: DataFrame, blocklist: str | None = None, dry_run: bool = False) -> DataFrame:
    """Replace the risky values in all records; returns the counts per kind of record with the total last."""
    found = second_pass.targets(assessments)
    if blocklist:
        block = review.numbered(tables.blocklist(spark, blocklist).withColumn("l", -F.length("value")), "l", "value")
        found = second_pass.merged(block.select("value", "token", F.col("flag_id").alias("place")), found)
    found, parts = written(found, "targets"), []
    for kind, schema in (("finetune", tables.FINETUNE), ("rag", tables.RAG)):
        if tables.exists(spark, f"{output}/{kind}"):
            folder = f"{output}/{kind}"
            base = snapshots.latest(spark, folder)
            done = second_pass.applied(snapshots.paths(snapshots.scan(spark, folder, schema, base)), found)
            if not dry_run:
                done = written(done, kind)
                hits = done.where("substitutions > 0").select("path").distinct()
                if hit := snapshots.touched(hits):
                    rows = done.join(hits, "path", "left_semi").drop("path", "substitutions", "bucket", "slug")
                    snapshots.replaced(spark, folder, base, hit, rows)
            parts.append(second_pass.stats(done.withColumn("file", F.lit(kind))))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p)
    stats = second_pass.total(stats)
    if not dry_run:
        stats = written(stats, "stats")
        changed = F.array_sort(F.collect_list(F.when((F.col("substitutions") > 0) & (F.col("file") != "TOTAL"), F.col("file"))))
        entry = stats.agg(F.lit(now()).alias("applied_at"), F.lit(found.count()).alias("terms_applied"), F.max("substitutions").alias("total_substitutions"), changed.alias("files_patched"))
        sinks.append_audit(entry, f"{output}/audit/second_pass_redactions")
    return stats
