"""Citation metadata from the start of an opinion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = 2000
#: Three independent, case-sensitive patterns.
CITATION = r"(\w[\w\s,\.]+v\.\s+[\w\s,\.]+,\s+\d+\s+\S+\s+\d+)"
YEAR = r"\((?:\w+\.?\s+)?(\d{4})\)"
COURT = r"\((\d+(?:st|nd|rd|th) Cir\.|S\.Ct\.)[^)]*\)"


def metadata(text: Column) -> Column:
    """``struct<citation, year, court>``; what is not there is null."""
    head = F.substring(text, 1, PREFIX)
    first = lambda p: F.nullif(F.regexp_extract(head, f"(?U){p}", 1), F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.struct(strip(first(CITATION)).alias("citation"), first(YEAR).cast("int").alias("year"), first(COURT).alias("court"))
