"""Where results go. Rows are written by the tasks; only one-row summaries come to the driver."""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import html_escape, one_place, thousands, two_places
from quillmill.operators import review
from quillmill.sources import snapshots


#: Folders that sources are dealt to; one for each source is for small sets.
BUCKETS = 256


def write_rag(records: DataFrame, folder: str, per_source: bool = False) -> None:
    """Overwritten; keys that do not apply are left out. Sources are dealt to a bounded number of folders, or have one each.

    Sources of the same slug share it, so ids are told apart by the metadata's source.
    """
    key = F.col("slug") if per_source else F.pmod(F.xxhash64("slug"), F.lit(BUCKETS))
    rows = records.withColumn("bucket", key).repartition("bucket") if not per_source else records.withColumn("bucket", key)
    rows.drop("slug").write.mode("overwrite").option("ignoreNullFields", True).partitionBy("bucket").json(folder)


def write_finetune(records: DataFrame, folder: str, mode: str = "append") -> None:
    if mode == "append":
        snapshots.appended(records.sparkSession, folder, records)
    else:
        records.write.mode(mode).option("ignoreNullFields", False).json(folder)


def write_review_log(flags: DataFrame, folder: str) -> None:
    """Flags hold the original personal data: keep the folder restricted."""
    rows = flags.select("file", "entity_type", "original_text", "confidence", "context", "action")
    snapshots.appended(flags.sparkSession, folder, rows)


def review_csv(flags: DataFrame) -> DataFrame:
    return flags.select(
        "flag_id", "file", "entity_type", "confidence", "original_text", "context", F.coalesce("decision", F.lit("approve")).alias("decision")
        if "decision" in flags.columns else F.lit("approve").alias("decision"),
    )


def flags_csv(flags: DataFrame) -> DataFrame:
    return flags.select("file", "entity_type", "confidence", "original_text", "context", "action")


def write_csv(rows: DataFrame, folder: str) -> None:
    """Fields as they are, blanks at their ends too."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', **blanks).csv(folder)


def write_manifest(meta: dict, files: DataFrame, summary: DataFrame, folder: str) -> None:
    """Files as JSON lines with their nulls, the summary with the dataset's fields beside them."""
    files.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/files")
    one = summary
    for key, value in meta.items():
        one = one.withColumn(key, F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value))
    one.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/summary")


def write_ocr_queue(found: DataFrame, folder: str) -> int:
    """Copies of rejected files (``filename, content``) by their names, a later one of a name over an earlier; their number."""

    def copy(batches):
        from pyarrow import fs

        for batch in batches:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist()):
                store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                store.create_dir(path, recursive=True)
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(content)
            yield batch.select(["filename"])

    return found.select("filename", "content").mapInArrow(copy, "filename string").count()


def archive_decisions(decisions: DataFrame, folder: str, stamp: str) -> str:
    """The decisions of one review as they came, under its time."""
    to = f"{folder}/decisions-{stamp[:19].replace(':', '').replace('-', '')}"
    write_csv(decisions, to)
    return to


def append_audit(entry: DataFrame, folder: str) -> None:
    entry.write.mode("append").option("ignoreNullFields", False).json(folder)


def write_risk_report(report: DataFrame, assessments: DataFrame, folder: str) -> None:
    """One row of counts, and the assessments as JSON lines beside it."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/report")
    assessments.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/assessments")


# ---- what a console shows


def result_lines(results: DataFrame, dry_run: bool = False) -> DataFrame:
    """A line for each file: its type, or SKIP, its name, tokens and flags."""
    status = F.rpad(F.when(F.col("skipped"), "SKIP").otherwise(F.upper("doc_type")), 12, " ")
    flags = F.when(F.col("review_flags") > 0, F.format_string(" | %d PII flags", "review_flags")).otherwise("")
    return results.select(F.concat(F.lit("[DRY RUN] " if dry_run else ""), status, F.lit(" "), "filename", F.format_string(" (%d tokens", "token_count"), flags, F.lit(")")).alias("line"))


def summary_lines(log: DataFrame) -> DataFrame:
    """Flags by type, by file with the three most frequent types, and the range of scores."""
    types = review.by_type(log).select(F.lit(0).alias("part"), (-F.col("n")).alias("o"), F.format_string("  %-25s %5d", "entity_type", "n").alias("line"))
    names = review.by_file(log, 3, ":").select(F.lit(1).alias("part"), (-F.col("n")).alias("o"), F.format_string("  %5d flags  %s [%s]", "n", "file", "types").alias("line"))
    score = review.confidence_stats(log).select(
        F.lit(2).alias("part"), F.lit(0).cast("long").alias("o"), F.concat(F.lit("Confidence range: "), two_places(F.col("lo")), F.lit(" - "), two_places(F.col("hi")), F.lit(" (avg "), two_places(F.col("mean")), F.lit(")")).alias("line")
    )
    return types.unionByName(names).unionByName(score).orderBy("part", "o", "line").select("line")


def flag_lines(log: DataFrame, limit: int = 20) -> DataFrame:
    rows = log.orderBy("flag_id").limit(limit) if limit else log.orderBy("flag_id")
    return rows.select(F.concat(F.format_string("[%d] ", F.col("flag_id") + 1), "entity_type", F.lit("  confidence="), two_places(F.col("confidence")), F.format_string("\nFile: %s\nDetected text: \"%s\"\nContext: ...%s...", "file", "original_text", "context")).alias("line"))


def show(lines: DataFrame) -> None:
    for row in lines.toLocalIterator():
        print(row["line"])


_PAGE = Template("<!DOCTYPE html><html><head><meta charset='utf-8'><title>$title</title></head><body><h1>$title</h1>$tables</body></html>")
RISK_MARKS = ("<!-- risk:begin -->", "<!-- risk:end -->")
#: Background colours of risk levels.
COLOURS = {"CRITICAL": "#7b0000", "HIGH": "#c0392b", "MEDIUM": "#e67e22", "LOW": "#27ae60"}


def summary_html(title: str, log: DataFrame, file_table: DataFrame) -> str:
    """The report over its aggregates, which are a row per type and file; texts are escaped in the plan."""
    tables = []
    types = review.by_type(log).orderBy(F.desc("n"), "first_flag").drop("first_flag")
    for head, frame in (
        ("Files", file_table.orderBy("sort_key").drop("sort_key").withColumn("token_count", thousands(F.col("token_count")))),
        ("Flags by type", types.withColumn("n", thousands(F.col("n"))).withColumn("pct", F.concat(one_place(F.col("pct")), F.lit("%")))),
        ("Flags by file", review.by_file(log).orderBy(F.desc("n"), "file")),
    ):
        safe = frame.select(*[html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in frame.columns])
        rows = "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in safe.toLocalIterator())
        tables.append(f"<h2>{head}</h2><table><tr>{''.join(f'<th>{c}</th>' for c in frame.columns)}</tr>{rows}</table>")
    return _PAGE.substitute(title=title.replace("&", "&amp;").replace("<", "&lt;"), tables="".join(tables))


def risk_section(distribution: DataFrame) -> str:
    """The number of assessments of each level, in its colour."""
    rows = {r["risk_level"]: r["n"] for r in distribution.collect()}  # a row per level
    return "".join(f"<p style='color:{COLOURS.get(k, '#555555')}'>{k}: {rows[k]}</p>" for k in sorted(rows))


def with_risk_section(page: str, section: str) -> str:
    """The page with its risk section put in or exchanged, in front of the body's end."""
    begin, end = RISK_MARKS
    if begin in page and end in page:
        page = page[: page.index(begin)] + page[page.index(end) + len(end) :]
    body = page.rfind("</body>")
    at = len(page) if body < 0 else body
    return f"{page[:at]}{begin}{section}{end}{page[at:]}"
