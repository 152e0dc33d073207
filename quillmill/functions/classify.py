"""Document types from weighted signals in the first characters of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.once import let

SAMPLE = 5000
THRESHOLD = 0.60
#: Patterns and weights by document type, in the order in which weights are added.
SIGNALS: dict[str, list[tuple[str, float]]] = {
    "caselaw": [
        (r"\d+\s+(?:F\.\d[dth]*|U\.S\.|S\.Ct\.|N\.E\.\d[dth]*|A\.\d[dth]*|P\.\d[dth]*|Cal\.|N\.Y\.|Ill\.|Tex\.)\s+\d+", 0.40),
        (r"\b(?:OPINION|HELD|AFFIRMED|REVERSED|JUDGMENT|PER CURIAM|VACATED|REMANDED)\b", 0.30),
        (r"(?:WESTLAW|LEXISNEXIS|© \d{4} Thomson Reuters|WL \d+)", 0.20),
    ],
    "published": [
        (r"\b(?:Vol\.|Volume)\s*\d+[,\s]+(?:No\.|Number|Issue)\s*\d+", 0.30),
        (r"(?:ISSN|ISBN)[:\s]+[\d\-X]+", 0.30),
        (r"\b(?:CLE|Continuing Legal Education|Law Review|Law Journal|Bar Journal|Bar Association)\b", 0.30),
        (r"©\s*\d{4}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}", 0.20),
    ],
    "private": [
        (r"(?:^|\n)(?:To|From|Subject|CC|BCC):\s+\S", 0.40),
        (r"\b(?:ATTORNEY FOR|ATTORNEYS FOR)\b", 0.35),
        (r"\b(?:PLAINTIFF|DEFENDANT|IN THE MATTER OF)\b", 0.35),
        (r"\bLAW DIVISION\b", 0.25),
        (r"(?:Dear\s+[A-Z][a-z]+|Sincerely,|Best regards,|Yours truly,|Kind regards,)", 0.30),
        (r"\b(?:CASE NOTE|CONFIDENTIAL|CLIENT FILE)\b", 0.25),
    ],
}
#: What every match of a pattern holds once it is in lower case, looked for first: one of some words, or a cheaper pattern.
HOLDS: dict[str, list[tuple[str, ...] | str]] = {
    "caselaw": [
        r"(?U)\d\s+(?:f\.|u\.s\.|s\.ct\.|n\.e\.|a\.|p\.|cal\.|n\.y\.|ill\.|tex\.)",
        ("opinion", "held", "affirmed", "reversed", "judgment", "per curiam", "vacated", "remanded"),
        ("westlaw", "lexisnexis", " thomson reuters", "wl "),
    ],
    "published": [
        ("vol.", "volume"),
        ("issn", "isbn"),
        ("cle", "continuing legal education", "law review", "law journal", "bar journal", "bar association"),
        ("©",),
    ],
    "private": [
        ("to:", "from:", "subject:", "cc:"),
        ("attorney for", "attorneys for"),
        ("plaintiff", "defendant", "in the matter of"),
        ("law division",),
        ("dear", "sincerely,", "best regards,", "yours truly,", "kind regards,"),
        ("case note", "confidential", "client file"),
    ],
}
#: Types by extension alone.
BY_EXTENSION = {".eml": ("private", 0.99), ".msg": ("private", 0.99), ".pptx": ("published", 0.90)}
TYPES = tuple(SIGNALS)
#: As Python's IGNORECASE and MULTILINE read the patterns.
FLAGS = "(?iumdU)"


def fires(text: Column, pattern: str) -> Column:
    return F.substring(text, 1, SAMPLE).rlike(FLAGS + pattern)


def raw_scores(text: Column) -> Column:
    """``struct<caselaw, published, private>`` of summed weights."""

    def scores(sample: Column, low: Column) -> Column:
        odd = F.contains(sample, F.lit("İ")) | F.contains(low, F.lit("ı")) | F.contains(low, F.lit("ſ"))
        out = []
        for kind, signals in SIGNALS.items():
            total = F.lit(0.0)
            for (pattern, weight), held in zip(signals, HOLDS[kind], strict=True):
                total = total + F.when(may_fire(low, odd, held) & sample.rlike(FLAGS + pattern), weight).otherwise(0.0)
            out.append(total.alias(kind))
        return F.struct(*out)

    return let(F.substring(text, 1, SAMPLE), lambda sample: let(F.lower(sample), lambda low: scores(sample, low)))


def may_fire(low: Column, odd: Column, held: tuple[str, ...] | str) -> Column:
    """Whether a text in lower case holds what is looked for; ``odd`` ones hold letters that the patterns take for i and s and ``lower`` does not."""
    if isinstance(held, str):
        return odd | low.rlike(held)
    hit = odd
    for word in held:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def classification(ext: Column, scores: Column) -> Column:
    """``struct<doc_type, confidence>`` from an extension and the scores of :func:`raw_scores`.

    The share of the best type must reach the threshold; at a tie none can.
    """
    total = sum((scores[t] for t in TYPES), F.lit(0.0))
    share = {t: scores[t] / total for t in TYPES}
    best = F.greatest(*share.values())
    kind = F.lit("uncertain")
    for t in reversed(TYPES):
        kind = F.when((best >= THRESHOLD) & (share[t] == best), t).otherwise(kind)
    found = F.when(total == 0, F.struct(F.lit("uncertain").alias("doc_type"), F.lit(0.0).alias("confidence"))).otherwise(
        F.struct(kind.alias("doc_type"), best.alias("confidence"))
    )
    for e, (t, c) in BY_EXTENSION.items():
        found = F.when(ext == e, F.struct(F.lit(t).alias("doc_type"), F.lit(c).alias("confidence"))).otherwise(found)
    return found


def fired_patterns(text: Column) -> Column:
    """``map<type, array<the first 40 characters of each pattern that fires>>``."""
    entries = []
    for kind, signals in SIGNALS.items():
        names = F.array(*[F.when(fires(text, p), F.lit(p[:40])) for p, _ in signals])
        entries.append(F.struct(F.lit(kind), F.filter(names, lambda x: x.isNotNull())))
    return F.map_from_entries(F.array(*entries))
