import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.operators import dedup, process, provenance, review, risk
from quillmill.sources import files, sinks, tables

MAIL = b"From: a@b.com\nTo: c@d.com\nSubject: Case\nContent-Type: text/plain\n\nBody of the mail, SSN 123-45-6789.\n"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


DOCX = zipped(word__document=f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t> x </w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>")
PPTX = zipped(ppt__slides__slide1=f"<p:sld {A}><p:sp><a:p><a:t>Title</a:t></a:p></p:sp><p:sp><a:p/></p:sp></p:sld>")


def test_folder_to_results(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    for name, data in {"a.txt": b"ab\xffcd\r\nx", "b.eml": MAIL, "c.docx": DOCX, "d.pptx": PPTX, "e.bin": b"?", "f.pdf": b"%PDF", "a.ocr.pdf": b"%PDF2", "copy.txt": b"ab\xffcd\r\nx", "g.docx": b"no zip"}.items():
        (folder / name).write_bytes(data)
    got = {r["filename"]: r for r in files.read(files.scan(spark, str(tmp_path / "in"))).collect()}
    assert set(got) == {"a.txt", "b.eml", "c.docx", "d.pptx", "f.pdf", "a.ocr.pdf", "copy.txt", "g.docx"}
    assert got["a.txt"]["raw"] == "ab�cd\nx"
    assert got["b.eml"]["raw"] == "From: a@b.com\nTo: c@d.com\nSubject: Case\n\nBody of the mail, SSN 123-45-6789."
    assert got["c.docx"]["raw"] == "First\nLast\nx | y" and got["d.pptx"]["raw"] == "[Slide 1]\nTitle"
    assert got["f.pdf"]["skipped"] and got["f.pdf"]["skip_reason"] == "no_reader" and got["g.docx"]["raw"] is None
    kept = {r["path"].rsplit("/", 1)[1] for r in dedup.best_versions(files.scan(spark, str(tmp_path / "in")).drop("content")).collect()}
    assert "copy.txt" not in kept and "a.ocr.pdf" not in kept and "a.txt" in kept


def test_scans_below_the_gate_are_skipped(spark):
    pdf = spark.createDataFrame([("p", "p.pdf", ".pdf", bytearray(b"x"))], "path string, filename string, ext string, content binary")
    scan = lambda c: lambda _: F.struct(F.lit("text of a scan").alias("text"), F.lit(c).cast("double").alias("confidence"))
    row = lambda **k: files.read(pdf, **k).first()
    assert row(ocr=scan(69.9))["skip_reason"] == "ocr_confidence_low" and row(ocr=scan(70))["raw"] == "text of a scan" and not row(ocr=scan(None))["skipped"]
    long = "word " * 40
    assert row(pdf=lambda _: F.lit(long))["raw"] == long and not row(pdf=lambda _: F.lit(long))["ocr"]
    bad = spark.createDataFrame([("p", "p.xyz", ".xyz", bytearray(b"x"))], "path string, filename string, ext string, content binary")
    with pytest.raises(Exception, match="Unsupported format"):
        files.read(bad).collect()


def test_process_and_sinks(spark, tmp_path):
    rows = [
        (1, "in/m.eml", "m.eml", ".eml", "To: x\nSSN 123-45-6789 and (312) 555-0100, (312) 555-0100.", False, None),
        (2, "in/o.txt", "o.txt", ".txt", "Smith v. Jones, 1 F.3d 2 OPINION", False, None), (3, "in/n.txt", "n.txt", ".txt", None, False, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, filename string, ext string, raw string, ocr boolean, ocr_confidence double")
    done = process.processed(docs).cache()
    by = {r["doc_id"]: r for r in done.collect()}
    assert "123-45" not in by[1]["text"] and by[1]["text"].count("(555) 555-0001") == 2 and by[1]["substitutions"] == 3 and len(by[1]["review_flags"]) == 2
    assert by[2]["doc_type"] == "caselaw" and by[2]["text"] == "Smith v. Jones, 1 F.3d 2 OPINION"
    sinks.write_rag(process.rag_records(done), str(tmp_path / "rag"))
    sinks.write_rag(process.rag_records(done), str(tmp_path / "each"), per_source=True)
    assert [p.name for p in (tmp_path / "each").glob("bucket=*")] == ["bucket=o"]
    lines = [json.loads(x) for p in (tmp_path / "rag").rglob("part-*.json") for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == ["o_chunk_000"] and "year" not in lines[0]["metadata"]
    sinks.write_finetune(process.finetune_records(done.where("doc_id = 1")), str(tmp_path / "ft"))
    sinks.write_finetune(process.finetune_records(done.where("doc_id = 1")), str(tmp_path / "ft"))
    assert tables.finetune(spark, str(tmp_path / "ft")).count() == 2
    log = review.numbered(process.review_log(done), "doc_id", "pos")
    sinks.write_csv(sinks.review_csv(log), str(tmp_path / "csv"))
    back = tables.csv(spark, str(tmp_path / "csv"), "flag_id int, file string, entity_type string, confidence double, original_text string, context string, decision string").collect()
    assert [(r["flag_id"], r["decision"], r["original_text"]) for r in back] == [(0, "approve", "(312) 555-0100"), (1, "approve", "(312) 555-0100")]
    side = spark.createDataFrame([("m.eml", "a", "b", "c")], tables.SIDECAR)
    manifest = provenance.provenance_files(process.results(done).withColumn("sha256", F.lit("h")), side)
    assert {r["original_filename"]: r["copyright_status"] for r in manifest.collect()} == {"m.eml": "a", "o.txt": "", "n.txt": ""}
    assert provenance.summary(manifest).first()["private_files"] == 1
    sinks.write_manifest({"dataset_name": "d", "jurisdiction_coverage": ["IL"]}, manifest, provenance.summary(manifest), str(tmp_path / "man"))
    page = sinks.summary_html("<Set>", log, provenance.file_table(manifest))
    assert "&lt;Set>" in page and "PHONE_NUMBER" in page
    once = sinks.with_risk_section(page, "R1")
    assert sinks.with_risk_section(once, "R2").count("R1") == 0 and once.count("R1") == 1


def test_blocklist_and_responses(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# c\n\nJohn\t[P]\n  x y \n")
    assert [tuple(r) for r in tables.blocklist(spark, str(tmp_path / "b.txt")).collect()] == [("John", "[P]"), ("x y", "[REDACTED]")]
    rows = spark.createDataFrame([('{"risk_level": "LOW"}',), ('```json\n{"risk_level": "HIGH"}\n```',), ("no",), (None,)], "response string")
    assert [r["risk_level"] for r in risk.parsed(rows).collect()] == ["LOW", "HIGH", "PARSE_ERROR", "PARSE_ERROR"]


def test_stream_takes_a_content_once(spark, tmp_path):
    from quillmill.streaming import ingest

    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.txt").write_text("OPINION of the court")
    (tmp_path / "in" / "c.txt").write_text("other")
    query = ingest.classify_into(ingest.arriving_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
