"""From texts to results: classify, clean, find and replace entities, chunk, route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import caselaw, chunks, classify, dates, naming, spans, text
from quillmill.functions.once import once

STRIPPED, RAG, FINETUNE = ("private", "uncertain"), ("caselaw", "published"), ("private", "uncertain", "published")


def classified(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """``docs (filename, ext, raw)`` with ``doc_type`` and ``confidence``, from the text before cleaning."""
    known = F.coalesce(F.col("ext").isin(*classify.BY_EXTENSION), F.lit(False))
    scored = once(docs, __scores=F.when(~known, classify.raw_scores(F.col(text_col))))
    found = once(scored, __c=classify.classification(F.col("ext"), F.col("__scores")))
    return found.withColumns({"doc_type": F.col("__c.doc_type"), "confidence": F.col("__c.confidence")}).drop("__c", "__scores")


def cleaned(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    return once(docs, clean=text.clean(F.col(text_col)))


def detected(docs: DataFrame, adapter: Callable | None = None, kinds: tuple[str, ...] = tuple(spans.RECOGNIZERS)) -> DataFrame:
    """``spans`` of the documents whose type is stripped; of ``kinds`` only.

    ``adapter``: a Column function from a text to further spans, such as :func:`quillmill.operators.names.tagger`; those that overlap
    a span of their own type found by pattern go.
    """
    stripped = F.col("doc_type").isin(*STRIPPED)
    empty = F.expr(f"cast(array() as {spans.TYPE})")
    patterns = F.when(stripped, spans.segmented(F.col("clean"), find=lambda t: spans.found(t, kinds))).otherwise(empty)
    if not adapter:
        return once(docs, spans=patterns)
    docs = docs.withColumn("__tagged", F.coalesce(adapter(F.when(stripped, F.col("clean"))), empty))
    out = once(docs, __found=patterns)
    return once(out, spans=spans.beside(F.col("__found"), F.col("__tagged"))).drop("__found", "__tagged")


def redacted(docs: DataFrame, excluded_col: str | None = None, mode: str = "finetune") -> DataFrame:
    """``text, substitutions, review_flags`` from ``clean`` and ``spans``; ``mode`` rag writes type tokens instead.

    ``substitutions`` counts spans before overlaps are removed.
    """
    found = spans.without(F.col("spans"), F.col(excluded_col)) if excluded_col else F.col("spans")
    out = once(docs, __found=found)
    out = once(out, __use=spans.redactable(F.col("__found")))
    out = once(out, __kept=spans.disjoint(F.col("__use")))
    kept = F.col("__kept")
    if mode == "rag":
        out = once(out, __values=spans.tokens(kept))
    else:
        days = F.when(F.size(kept) > 0, dates.offset_days(F.col("clean")))
        out = once(once(out, __days=days), __values=spans.surrogates(kept, F.col("__days"))).drop("__days")
    return once(
        out,
        text=F.when(F.size(kept) == 0, F.col("clean")).otherwise(spans.replaced(F.col("clean"), kept, F.col("__values"))),
        substitutions=F.size("__use"),
        review_flags=spans.review_flags(F.col("clean"), F.col("filename"), F.col("__found")),
    ).drop("__found", "__use", "__kept", "__values")


def flagged(docs: DataFrame, excluded_col: str | None = None) -> DataFrame:
    """``substitutions, review_flags`` of the detected spans, where no text is wanted."""
    found = spans.without(F.col("spans"), F.col(excluded_col)) if excluded_col else F.col("spans")
    out = once(docs, __found=found)
    return once(out, substitutions=F.size(spans.redactable(F.col("__found"))), review_flags=spans.review_flags(F.col("clean"), F.col("filename"), F.col("__found"))).drop("__found")


def reviewed(docs: DataFrame, excluded_col: str | None = None) -> DataFrame:
    """``review_flags`` of ``docs (filename, doc_type, raw)`` that can have any: those that are stripped and hold what every flagged type does.

    The others go before they are cleaned, and by their text before they are classified, as the optimizer moves that condition down; only types
    that are flagged are looked for.
    """
    rows = cleaned(docs.where(spans.may_be_reviewed(F.col("raw"))).where(F.col("doc_type").isin(*STRIPPED)))
    return flagged(detected(rows, kinds=spans.REVIEWED), excluded_col).drop("substitutions")


def chunked(docs: DataFrame, count: Callable[[str], int] = chunks.word_tokens) -> DataFrame:
    out = docs.withColumn("chunks", chunks.chunked(F.col("text"), F.col("doc_type"), count))
    return out.withColumns({"chunk_count": F.size("chunks"), "token_count": F.aggregate("chunks", F.lit(0), lambda a, c: a + c["token_count"])})


def processed(docs: DataFrame, adapter: Callable | None = None, count: Callable[[str], int] = chunks.word_tokens) -> DataFrame:
    """The whole run over ``docs (filename, ext, raw, ocr, ocr_confidence)``: one lazy plan."""
    return chunked(redacted(detected(cleaned(classified(docs)), adapter)), count)


def results(done: DataFrame) -> DataFrame:
    """One row per file, as the console and the manifest report it."""
    return done.select(
        "path", "filename", "doc_type", "confidence", "ocr", "ocr_confidence", F.col("doc_type").isin(*STRIPPED).alias("pii_stripped"),
        F.col("substitutions").alias("faker_substitutions"), F.size("review_flags").alias("review_flags"), "chunk_count", "token_count",
        F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("skip_reason"),
    )


def skipped_results(files: DataFrame) -> DataFrame:
    """The rows of files that were not processed, ``files (path, filename, skip_reason)``: of type unknown, with nothing done."""
    zero = F.lit(0)
    return files.select(
        "path", "filename", F.lit("unknown").alias("doc_type"), F.lit(0.0).alias("confidence"), F.lit(True).alias("ocr"), F.lit(None).cast("double").alias("ocr_confidence"),
        F.lit(False).alias("pii_stripped"), zero.alias("faker_substitutions"), zero.alias("review_flags"), zero.alias("chunk_count"), zero.alias("token_count"),
        F.lit(True).alias("skipped"), "skip_reason",
    )


def review_log(done: DataFrame) -> DataFrame:
    return done.select("doc_id", F.posexplode("review_flags").alias("pos", "flag")).select("doc_id", "pos", "flag.*")


def rag_records(done: DataFrame) -> DataFrame:
    """``id, text, metadata`` per chunk of the types that go to retrieval; keys that do not apply are null."""
    rows = done.where(F.col("doc_type").isin(*RAG)).withColumn(
        "__meta", F.when(F.col("doc_type") == "caselaw", caselaw.metadata(F.col("clean")))
    )
    one = rows.select("filename", "doc_type", "ocr", "__meta", naming.slug(F.col("filename")).alias("slug"), F.explode("chunks").alias("c"))
    return one.select(
        F.format_string("%s_chunk_%03d", "slug", "c.index").alias("id"), F.col("c.text").alias("text"),
        F.struct(
            F.col("filename").alias("source"), "doc_type", F.col("c.index").alias("chunk_index"), F.col("c.total").alias("total_chunks"),
            F.col("c.token_count").alias("token_count"), F.col("__meta.citation").alias("citation"), F.col("__meta.year").alias("year"),
            F.col("__meta.court").alias("court"), "ocr",
        ).alias("metadata"), "slug",
    )


def finetune_records(done: DataFrame) -> DataFrame:
    """One record of the whole text per document of the types that go to fine-tuning."""
    return done.where(F.col("doc_type").isin(*FINETUNE)).select(
        "text",
        F.struct(
            naming.anonymous_id(F.col("filename")).alias("source"), "doc_type", F.col("doc_type").isin(*STRIPPED).alias("pii_stripped"),
            F.col("substitutions").alias("faker_substitutions"), F.size("review_flags").alias("review_flags"), "token_count",
        ).alias("metadata"),
    )
