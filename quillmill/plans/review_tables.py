"""Review and risk tables made from the corpus by fixed rules, for the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.sql import ANON, q

KINDS = ["case_caption", "full_name", "other", "court", "x", "date_signed", "email", "facility/address", "name", "dob", " COURT ", "ssn"]
VALUES = [
    "Smith v. Jones / 123 F.3d 456", "Jane Roe; John Doe", "person", "Illinois Bar Journal (also ISSN: 0019-1876)", "(a description)", "2019",
    "jane@example.com", "Page header", "→ arrow", "e.g. this", "SEVENTH CIRCUIT", "ab",
]
EXTRA = [["numbered line"], ["$5 (net) \\ cost", "numbered LINE"], [], ["after a gap", "redacted"]]
LEVELS = ["LOW", "MEDIUM", "HIGH", "PARSE_ERROR", None, "CRITICAL", "ERROR"]
BLOCKLIST = ["# comment", "", "Bar Journal\t[JOURNAL]", "quoted", "  OPINION \t [WORD] ", "\t[EMPTY]"]


def decided(log: DataFrame) -> DataFrame:
    """Decisions by flag number: restore with blanks and capitals, approve, none."""
    i = F.col("flag_id") % 3
    return log.withColumn("decision", F.when(i == 0, " Restore ").when(i == 1, "approve"))


def assessments(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, filename)``: one assessment a document."""
    i = F.col("doc_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)
    strings = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    extra = F.element_at(F.array(*map(strings, EXTRA)), (i % len(EXTRA)).cast("int") + 1)
    level = F.lit(None).cast("string")
    for k, name in enumerate(LEVELS):
        level = F.when(i % len(LEVELS) == k, F.lit(name).cast("string")).otherwise(level)
    qi = F.array(*[F.struct(pick(KINDS, i + k).alias("type"), pick(VALUES, i + k).alias("value")) for k in (0, 5)])
    return docs.select(
        i.alias("pos"), F.concat(F.lit("anon_"), F.substring(F.sha2("filename", 256), 1, 16)).alias("source"), level.alias("risk_level"),
        qi.alias("quasi_identifiers"), extra.alias("additional_redactions"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else _list(v) for v in values) + "]"


ASSESSMENTS = f"""assessments AS (SELECT doc_id AS pos, {ANON} AS source, ({_list(LEVELS)})[doc_id % {len(LEVELS)} + 1] AS risk_level,
 [{', '.join(f"{{'type': ({_list(KINDS)})[(doc_id + {k}) % {len(KINDS)} + 1], 'value': ({_list(VALUES)})[(doc_id + {k}) % {len(VALUES)} + 1]}}" for k in (0, 5))}] AS quasi_identifiers,
 ([{', '.join(_list(e) + '::VARCHAR[]' for e in EXTRA)}])[doc_id % {len(EXTRA)} + 1] AS additional_redactions FROM corpus)"""
BLOCK_ROWS = "block_lines AS (SELECT unnest([" + ", ".join("'" + b.replace("\t", "'||chr(9)||'") + "'" for b in BLOCKLIST) + "]) AS value)"
