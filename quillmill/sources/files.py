"""Documents as files: a scan of a folder, and a text from each format.

Texts are decoded inside the JVM. Formats that need a parser go through Arrow functions: mail, and the two
office formats, whose XML the standard library reads. PDF, scans and Outlook mail need a library that may
be missing; they take an adapter and without one leave the text null with a reason.
"""

from __future__ import annotations

import email
import email.policy
import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.naming import EXTENSIONS, extension, filename

OCR_GATE, PDF_LEAST = 70.0, 100
HEADERS = ("From", "To", "Subject", "Date", "CC", "BCC")


def scan(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """``path, filename, ext, size_bytes, sha256, content`` of all files of a known extension below a folder, or of the files listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.withColumn("filename", filename(F.col("path"))).withColumn("ext", extension(F.col("filename")))
    return named.where(F.col("ext").isin(*EXTENSIONS)).select(
        "path", "filename", "ext", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content"
    )


def decode_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is none, and line ends as LF."""
    from quillmill.functions.text import newlines

    return newlines(F.make_valid_utf8(content.cast("string")))


def _by(parse: Callable[[bytes], str | None]):
    @F.arrow_udf("string")
    def run(contents: pa.Array) -> pa.Array:
        return pa.array([None if c is None else parse(c) for c in contents.to_pylist()], pa.string())

    return run


def mail_text(content: bytes) -> str:
    """The headers that are there, a blank line, and the first plain part with a payload, read as UTF-8."""
    message = email.message_from_bytes(content)
    head = "\n".join(f"{k}: {message[k]}" for k in HEADERS if message[k])
    body = ""
    parts = (p for p in message.walk() if p.get_content_type() == "text/plain") if message.is_multipart() else [message]
    for part in parts:
        payload = part.get_payload(decode=True)
        if payload:
            body = payload.decode("utf-8", errors="replace")
            break
    return f"{head}\n\n{body}".strip()


def outlook_text(mail: Column) -> Column:
    """The text of ``struct<sender, to, subject, date, body>`` as an Outlook reader gives it: four lines, even empty ones, and the body."""
    part = lambda c: F.coalesce(mail[c].cast("string"), F.lit(""))
    lines = [F.concat(F.lit(f"{name}: "), part(c)) for name, c in (("From", "sender"), ("To", "to"), ("Subject", "subject"), ("Date", "date"))]
    return F.regexp_replace(F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), part("body")), r"(?U)^\s+|\s+$", "")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def _run_text(node) -> str:
    return "".join(e.text or "" if e.tag == f"{_W}t" else _BREAKS.get(e.tag, "") for e in node.iter())


def docx_text(content: bytes) -> str | None:
    """Paragraphs of the body that are not blank, then the rows of its tables, cells joined by a bar."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    parts = [t for p in body.findall(f"{_W}p") if (t := _run_text(p)).strip()]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        cells = ["\n".join(_run_text(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
        if line := " | ".join(c for c in cells if c):
            parts.append(line)
    return "\n".join(parts)


def _shape_text(shape) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")).strip()


def pptx_text(content: bytes) -> str | None:
    """Slides in order: a mark with the number, the shapes' texts, the notes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            slides = sorted((n for n in names if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n.rsplit("/", 1)[1])) or 0))
            parts = []
            for i, name in enumerate(slides, 1):
                parts.append(f"[Slide {i}]")
                parts += [t for s in ElementTree.fromstring(z.read(name)).iter(f"{_P}sp") if (t := _shape_text(s))]
                notes = name.replace("slides/slide", "notesSlides/notesSlide")
                if notes in names:
                    body = [t for s in ElementTree.fromstring(z.read(notes)).iter(f"{_P}sp") if any(x.get("type") == "body" for x in s.iter(f"{_P}ph")) and (t := _shape_text(s))]
                    if body:
                        parts.append(f"[Notes] {chr(10).join(body)}")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join(parts)


def read(
    files: DataFrame,
    pdf: Callable[[Column], Column] | None = None,
    msg: Callable[[Column], Column] | None = None,
    ocr: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``files`` of :func:`scan` with ``raw, ocr, ocr_confidence, skipped, skip_reason``.

    ``pdf`` and ``msg`` give a text; ``ocr`` gives ``struct<text, confidence>`` and runs where a PDF's text has
    under 100 characters. A scan whose confidence is known and under 70 is skipped. An extension that is not
    known raises an error.
    """
    none = F.lit(None).cast("string")
    content, ext = F.col("content"), F.col("ext")
    plain = pdf(content) if pdf else none
    thin = F.length(F.regexp_replace(F.coalesce(plain, F.lit("")), r"(?U)^\s+|\s+$", "")) < PDF_LEAST
    scanned = ocr(content) if ocr else F.lit(None).cast("struct<text:string,confidence:double>")
    by_ext = {
        ".txt": decode_text(content), ".eml": _by(mail_text)(F.when(ext == ".eml", content)), ".docx": _by(docx_text)(F.when(ext == ".docx", content)),
        ".pptx": _by(pptx_text)(F.when(ext == ".pptx", content)), ".msg": msg(content) if msg else none, ".pdf": F.when(~thin, plain),
    }
    raw = F.raise_error(F.concat(F.lit("Unsupported format: "), ext))
    for e, text in by_ext.items():
        raw = F.when(ext == e, text).otherwise(raw)
    out = files.withColumn("raw", raw).withColumn("__ocr", F.when((ext == ".pdf") & F.col("raw").isNull(), scanned))
    low = ocr_rejected(F.col("__ocr.confidence"))
    return (
        out.withColumn("ocr", F.col("__ocr").isNotNull()).withColumn("ocr_confidence", F.col("__ocr.confidence"))
        .withColumn("raw", F.coalesce("raw", F.when(~low, F.col("__ocr.text"))))
        .withColumn("skipped", F.col("raw").isNull())
        .withColumn("skip_reason", F.when(low, "ocr_confidence_low").when(F.col("raw").isNull(), "no_reader"))
        .drop("__ocr", "content")
    )


def ocr_rejected(confidence: Column) -> Column:
    """An unknown confidence passes."""
    return F.coalesce(confidence < OCR_GATE, F.lit(False))


def ocr_confidence(words: DataFrame, pages: int = 3) -> DataFrame:
    """``words (path, page, confidence)``: the mean of positive confidences on the first pages of each file."""
    return words.where((F.col("page") < pages) & (F.col("confidence") > 0)).groupBy("path").agg(F.avg("confidence").alias("ocr_confidence"))
