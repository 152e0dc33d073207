"""Versions of folders of JSON lines: readers and writers that overlap, files that stay, writers that meet or die."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill import runs
from quillmill.sources import sinks, snapshots, tables


@pytest.fixture
def folder(spark, tmp_path):
    """Forty records in eight files, in a folder whose name a list has to keep as it is."""
    place = str(tmp_path / "of 100% + ü")
    meta = "named_struct('source', concat('s', id), 'doc_type', 'private', 'pii_stripped', true, 'faker_substitutions', 0, 'review_flags', 0, 'token_count', 1) as metadata"
    sinks.write_finetune(spark.range(0, 40, 1, 8).selectExpr("concat('text ', id) as text", meta), place)
    return place


def news(spark, sources, text="new"):
    rows = spark.createDataFrame([(s,) for s in sources], "source string")
    meta = F.struct("source", *[F.lit(None).cast(t).alias(n) for n, t in (("doc_type", "string"), ("pii_stripped", "boolean"), ("faker_substitutions", "int"), ("review_flags", "int"), ("token_count", "int"))])
    return rows.select("source", F.concat(F.lit(f"{text} "), "source").alias("text"), meta.alias("metadata"))


def texts(df):
    return {r["metadata"]["source"]: r["text"] for r in df.select("metadata", "text").collect()}


def test_only_files_with_changed_rows_are_written_anew(spark, folder):
    before = texts(tables.finetune(spark, folder))
    files = {f: os.stat(f.removeprefix("file:")).st_mtime_ns for f in snapshots.listed(spark, folder)}
    assert len(files) == 8 and runs.patch_records(spark, folder, news(spark, ["s1", "s2", "s33", "nobody"])) == 2
    after = snapshots.listed(spark, folder)
    assert len(set(files) - set(after)) == 2 and all(os.stat(f.removeprefix("file:")).st_mtime_ns == t for f, t in files.items())
    want = before | {s: f"new {s}" for s in ("s1", "s2", "s33")}
    assert texts(tables.finetune(spark, folder)) == want and tables.finetune(spark, folder).count() == 40
    assert runs.patch_records(spark, folder, news(spark, ["nobody"])) == 0 and snapshots.versions(spark, folder) == [1]
    assert runs.patch_records(spark, folder, news(spark, ["s2"], "newer")) >= 1
    assert texts(tables.finetune(spark, folder)) == want | {"s2": "newer s2"}
    assert [texts(tables.jsonl(spark, folder, tables.FINETUNE, n)) for n in (0, 1)] == [before, want]


def test_a_reader_keeps_the_files_it_began_with(spark, folder):
    first = tables.finetune(spark, folder)
    before = texts(first)
    runs.patch_records(spark, folder, news(spark, ["s5"]))
    second = tables.finetune(spark, folder)
    runs.patch_records(spark, folder, news(spark, ["s5", "s6"], "newer"))
    assert texts(first) == before and texts(second) == before | {"s5": "new s5"}
    assert texts(tables.finetune(spark, folder)) == before | {"s5": "newer s5", "s6": "newer s6"}


def test_a_writer_reads_what_it_replaces(spark, folder):
    base = snapshots.latest(spark, folder)
    rows = snapshots.scan(spark, folder, tables.FINETUNE, base)
    snapshots.replaced(spark, folder, base, snapshots.listed(spark, folder, base), rows.withColumn("text", F.upper("text")))
    assert set(texts(tables.finetune(spark, folder)).values()) == {f"TEXT {i}" for i in range(40)}


def test_of_two_writers_of_one_version_the_second_is_told(spark, folder):
    rows = tables.finetune(spark, folder).drop("file").limit(1)
    snapshots.replaced(spark, folder, 0, [], rows)
    with pytest.raises(snapshots.Conflict, match="1.claim"):
        snapshots.replaced(spark, folder, 0, [], rows)
    assert snapshots.versions(spark, folder) == [1] and tables.finetune(spark, folder).count() == 41


def test_a_writer_that_fails_leaves_the_version_before(spark, folder):
    before = texts(tables.finetune(spark, folder))
    broken = tables.finetune(spark, folder).drop("file").withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        snapshots.replaced(spark, folder, 0, snapshots.listed(spark, folder), broken)
    assert texts(tables.finetune(spark, folder)) == before and snapshots.versions(spark, folder) == []
    Path(folder, "_snapshots", "1").mkdir()  # a list without its end is none
    assert snapshots.latest(spark, folder) == 0
    runs.patch_records(spark, folder, news(spark, ["s5"]))
    assert texts(tables.finetune(spark, folder)) == before | {"s5": "new s5"}


def test_appending_and_forgetting(spark, folder):
    more = tables.finetune(spark, folder).drop("file").where("metadata.source = 's7'")
    sinks.write_finetune(more, folder)
    assert snapshots.versions(spark, folder) == [] and tables.finetune(spark, folder).count() == 41
    runs.patch_records(spark, folder, news(spark, ["s5"]))
    sinks.write_finetune(tables.finetune(spark, folder).drop("file").where("metadata.source = 's5'"), folder)
    assert snapshots.versions(spark, folder) == [1, 2] and tables.finetune(spark, folder).count() == 42
    now = texts(tables.finetune(spark, folder))
    assert snapshots.expire(spark, folder, 2) == 1 and snapshots.expire(spark, folder) == 0
    assert texts(tables.finetune(spark, folder)) == now and snapshots.versions(spark, folder) == [2]


def test_a_log_without_flags_of_a_file(spark, tmp_path):
    place = str(tmp_path / "log")
    names = spark.createDataFrame([("f3", ["x"])], "file string, excluded array<string>")
    none = spark.createDataFrame([], tables.FLAGS)
    assert runs.patch_log(spark, place, none, names) == 0 and not os.path.exists(place)
    flags = spark.range(0, 20, 1, 5).selectExpr("concat('f', id) as file", "'US_SSN' as entity_type", "'t' as original_text", "0.9d as confidence", "'c' as context", "'redacted' as action")
    sinks.write_review_log(flags, place)
    again = flags.limit(1).withColumn("file", F.lit("f3")).withColumn("original_text", F.lit("u"))
    assert runs.patch_log(spark, place, again, names) == 1
    got = {r["file"]: r["original_text"] for r in tables.review_log(spark, place).collect()}
    assert got == {f"f{i}": "t" for i in range(20)} | {"f3": "u"}
    assert runs.patch_log(spark, place, none, names) == 1 and tables.review_log(spark, place).count() == 19


def test_a_partitioned_folder_becomes_a_list(spark, tmp_path):
    place = str(tmp_path / "rag")
    meta = "named_struct('source', concat('s', id), 'doc_type', 'private', 'chunk_index', 0, 'total_chunks', 1, 'token_count', 1) as metadata"
    sinks.write_rag(spark.range(12).selectExpr("cast(id as string) as id", "concat('text ', id) as text", meta, "concat('s', id) as slug"), place)
    hit = snapshots.touched(snapshots.paths(snapshots.scan(spark, place, tables.RAG)).where("id = '3'"))
    rows = snapshots.scan(spark, place, tables.RAG, 0, hit)
    assert len(hit) == 1
    snapshots.replaced(spark, place, 0, hit, rows.withColumn("text", F.lit("new")))
    got = {r["id"]: r["text"] for r in tables.rag(spark, place).collect()}
    assert len(got) == 12 and got["3"] == "new" and got["4"] == "text 4"
