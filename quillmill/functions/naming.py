"""File names: extensions, stems, slugs and anonymous ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions read, in the order in which versions of a document are preferred.
EXTENSIONS = (".txt", ".pdf", ".docx", ".pptx", ".eml", ".msg")
#: Endings of stems that mark a scan with recognised text, in the order in which they go.
OCR_ENDINGS = (".ocr", "-ocr", "_ocr", "-ocr.pdf", " searchable copy")


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """The last dot and what follows, in lower case; empty without one or where the name only starts with it."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def canonical_stem(name: Column) -> Column:
    """The stem without scan endings, each taken off once in order, in lower case and stripped."""
    out = stem(name)
    for end in OCR_ENDINGS:
        out = F.regexp_replace(out, "(?i)" + re.escape(end) + "$", "")
    return F.regexp_replace(F.lower(out), r"(?U)^\s+|\s+$", "")


def is_ocr(name: Column) -> Column:
    low = F.lower(stem(name))
    return low.rlike("(?:" + "|".join(map(re.escape, OCR_ENDINGS)) + ")$")


def extension_rank(ext: Column) -> Column:
    rank = F.lit(99)
    for k, e in reversed(list(enumerate(EXTENSIONS))):
        rank = F.when(ext == e, k).otherwise(rank)
    return rank


def slug(name: Column) -> Column:
    """The stem in lower case, everything else than letters and digits as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(stem(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def anonymous_id(name: Column) -> Column:
    """The same in every run: the start of the name's SHA-256."""
    return F.concat(F.lit("anon_"), F.substring(F.sha2(name, 256), 1, 16))


def path_parts(path: Column) -> Column:
    """Sorts as paths do, part by part."""
    return F.split(path, "/")
