"""Entities as arrays of spans, found, tiered, freed of overlaps and replaced inside one row.

A span is ``struct<entity_type, start, end, score, text>``; offsets count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.dates import STYLES, shift
from quillmill.functions.once import let

HIGH, LOW, CONTEXT = 0.85, 0.50, 60
#: What stands between the name of a number and the number.
_NO = r"(?i:(?: (?:number|no\.?|#))?:? ?#?)"
_NAME = r"[A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,2}\b"
#: Type: (pattern, score, what must stand in front of it). The scores are our own, but for the social security number's.
#: Persons are found behind titles and places as street addresses; other names need a model, which is an adapter.
RECOGNIZERS: dict[str, tuple[str, float, str]] = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,5}\.[A-Za-z]{2,24}", 1.0, ""),
    "US_SSN": (r"\b\d{3}-\d{2}-\d{4}\b", 0.90, ""),
    "CREDIT_CARD": (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}\b", 0.60, ""),
    "PHONE_NUMBER": (r"(?:\+\d{1,3} )?\(\d{3}\) ?\d{3}-\d{4}\b", 0.75, ""),
    "IP_ADDRESS": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.95, ""),
    "DATE_TIME": ("|".join(p.replace("(?i)", "") for p, _ in STYLES.values()), 0.85, ""),
    "PERSON": (_NAME, 0.85, r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Hon)\.? "),
    "LOCATION": (r"\b\d{1,5} (?:[A-Z][a-z]{1,30} ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court)\b", 0.85, ""),
    "US_BANK_NUMBER": (r"\d{8,17}\b", 0.60, r"\b(?i:account|acct|routing)" + _NO),
    "US_PASSPORT": (r"[A-Z]?\d{8,9}\b", 0.60, r"\b(?i:passport)" + _NO),
    "US_DRIVER_LICENSE": (r"[A-Z]\d{3,14}\b", 0.65, r"\b(?i:driver'?s? licen[sc]e|DL)" + _NO),
    "MEDICAL_LICENSE": (r"[A-Za-z]{2}\d{7}\b", 0.65, r"\b(?i:DEA|medical licen[sc]e)" + _NO),
}
#: Words near a number that raise its score, by as much, up to 1.
NEAR = {"US_SSN": ("(?i)social security|ssn", 0.10)}
#: What every match of a costly pattern holds, looked for first.
HOLDS = {
    "EMAIL_ADDRESS": "@", "DATE_TIME": r"[\s/-]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b", "CREDIT_CARD": r"\d{4}[ -]?\d{4}", "PHONE_NUMBER": r"\(\d{3}\)",
    "US_BANK_NUMBER": r"\d{8}", "US_PASSPORT": r"\d{8}", "US_DRIVER_LICENSE": r"[A-Z]\d{3}", "MEDICAL_LICENSE": r"[A-Za-z]\d{7}",
}
#: Types that can be of medium score, so that a person looks at them.
REVIEWED = tuple(k for k, (_, score, _) in RECOGNIZERS.items() if any(LOW <= s < HIGH for s in (score, min(score + NEAR.get(k, ("", 0.0))[1], 1.0))))
MARK = "\u0001"
#: What stands between two digits of a text as it comes where one blank or hyphen stands once it is cleaned and searched.
_GAP = rf"[ \t{MARK}–-]*+"
#: What a text as it comes holds where a type of :data:`REVIEWED` is found in it once it is cleaned: at three digits, so that one look at each other character does.
MAY_HOLD_REVIEWED = rf"\d{{3}}(?:(?<=\(\d{{3}})\)|(?<=[A-Z]\d{{3}})|(?<=[A-Za-z]\d{{3}})\d{{4}}|\d{{5}}|\d{_GAP}\d{{4}}{_GAP}\d{{4}}{_GAP}\d)"
TYPE = "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"


def marked(kind: str) -> tuple[str, str]:
    """The pattern of a type as two groups, what stands in front and the entity, and the pattern as a whole."""
    pattern, _, front = RECOGNIZERS[kind]
    flags = "(?i)" if kind == "DATE_TIME" else ""
    return f"{flags}({front})({pattern})", f"{flags}{front}(?:{pattern})"


def _step(kind: str, score: Column):
    """Every second piece is an entity."""

    def step(a: Column, piece: Column) -> Column:
        end = (a["at"] + F.length(piece)).cast("int")
        span = F.struct(F.lit(kind).alias("entity_type"), a["at"].alias("start"), end.alias("end"), score.alias("score"), piece.alias("text"))
        return F.struct(end.alias("at"), (~a["even"]).alias("even"), F.when(a["even"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return step


def found(text: Column, kinds: tuple[str, ...] = tuple(RECOGNIZERS)) -> Column:
    """All spans of the recognizers, in the order of the recognizers and of their places.

    A pattern's matches are marked and the text is cut at the marks; one fold over the pieces adds up their lengths,
    which are the offsets in code points.
    """
    return let(F.replace(text, F.lit(MARK), F.lit(" ")), lambda t: _found(t, kinds))


def _found(text: Column, kinds: tuple[str, ...]) -> Column:
    none = f"cast(array() as {TYPE})"
    parts = []
    for kind in kinds:
        groups, whole = marked(kind)
        score = F.lit(RECOGNIZERS[kind][1])
        if kind in NEAR:
            score = F.when(text.rlike(NEAR[kind][0]), F.least(score + NEAR[kind][1], F.lit(1.0))).otherwise(score)
        cut = F.split(F.regexp_replace(text, groups, f"$1{MARK}$2{MARK}"), MARK, -1)
        start = F.expr(f"named_struct('at', 0, 'even', false, 'out', {none})")
        spans = F.aggregate(cut, start, _step(kind, score), lambda a: a["out"])
        hit = text.rlike(HOLDS[kind]) & text.rlike(whole) if kind in HOLDS else text.rlike(whole)
        parts.append(F.when(hit, spans).otherwise(F.expr(none)))
    return F.concat(*parts)


def may_be_reviewed(raw: Column) -> Column:
    """Whether a text, before it is cleaned, can have spans of :data:`REVIEWED`; cleaning joins digits over blanks and dashes only."""
    return raw.rlike(MAY_HOLD_REVIEWED)


#: Characters of a text beyond which :func:`segmented` cuts.
SEGMENT = 900_000


def segmented(text: Column, size: int = SEGMENT, find=found) -> Column:
    """``find`` over slices of a text of more than ``size`` characters, with the offsets of the whole; what lies across a border can be cut."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    moved = lambda spans, at: F.transform(spans, lambda e: F.struct(e["entity_type"], (e["start"] + at).cast("int").alias("start"), (e["end"] + at).cast("int").alias("end"), e["score"], e["text"]))
    slices = F.flatten(F.transform(starts, lambda at: moved(find(F.substring(text, at + 1, F.lit(size))), at)))
    return F.when(F.length(text) > size, slices).otherwise(find(text))


def beside(found: Column, tagged: Column) -> Column:
    """``found`` and those of ``tagged`` that overlap no span of their type in it."""
    apart = lambda t: ~F.exists(found, lambda e: (e["entity_type"] == t["entity_type"]) & (e["start"] < t["end"]) & (t["start"] < e["end"]))
    return F.concat(found, F.filter(tagged, apart))


def tier(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= LOW, "medium")


def redactable(spans: Column) -> Column:
    """High ones, then medium ones; the rest goes."""
    return F.concat(F.filter(spans, lambda e: e["score"] >= HIGH), F.filter(spans, lambda e: (e["score"] >= LOW) & (e["score"] < HIGH)))


def without(spans: Column, excluded: Column) -> Column:
    """Spans whose exact text a reviewer has restored go."""
    return F.filter(spans, lambda e: ~F.coalesce(F.array_contains(excluded, e["text"]), F.lit(False)))


def disjoint(spans: Column) -> Column:
    """By start, longer ones first, each that starts at or behind the end of the one kept last."""
    order = F.array_sort(F.transform(spans, lambda e: F.struct(e["start"].alias("s"), (e["start"] - e["end"]).alias("l"), e.alias("e"))))
    empty = F.expr(f"named_struct('end', 0, 'kept', cast(array() as {TYPE}))")
    fold = F.aggregate(
        order, empty,
        lambda a, x: F.when(x["s"] < a["end"], a).otherwise(
            F.struct(x["e"]["end"].alias("end"), F.concat(a["kept"], F.array(x["e"])).alias("kept"))
        ),
    )
    return fold["kept"]


def replaced(text: Column, kept: Column, values: Column) -> Column:
    """The text with the i-th of the disjoint spans replaced by the i-th value; a piece in front of each, then the rest."""
    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(kept, F.greatest(i - 1, F.lit(0)))["end"])
    piece = lambda e, i: F.concat(F.substring(text, last(i) + 1, e["start"] - last(i)), F.get(values, i))
    tail = F.substring(text, F.element_at(kept, -1)["end"] + 1, F.length(text))
    return F.when(F.size(kept) == 0, text).otherwise(F.concat(F.array_join(F.transform(kept, piece), ""), tail))


def tokens(kept: Column) -> Column:
    return F.transform(kept, lambda e: F.concat(F.lit("["), e["entity_type"], F.lit("]")))


def synthetic(kind: Column, n: Column) -> Column:
    """A made-up value of a type by number; reserved ranges throughout."""
    return (
        F.when(kind == "EMAIL_ADDRESS", F.format_string("user%d@example.com", n))
        .when(kind == "US_SSN", F.format_string("900-00-%04d", n))
        .when(kind == "CREDIT_CARD", F.format_string("4000 0000 0000 %04d", n))
        .when(kind == "PHONE_NUMBER", F.format_string("(555) 555-%04d", n))
        .when(kind == "IP_ADDRESS", F.when(n < 256, F.format_string("192.0.2.%d", n)).otherwise(F.format_string("198.%d.%d.%d", 18 + F.floor(n / 65536) % 2, F.floor(n / 256) % 256, n % 256)))
        .when(kind == "PERSON", F.format_string("Person %d", n))
        .when(kind == "LOCATION", F.format_string("%d Example Street", n))
        .when(kind == "US_BANK_NUMBER", F.format_string("0000%06d", n))
        .when(kind == "US_PASSPORT", F.format_string("000%06d", n))
        .when(kind == "US_DRIVER_LICENSE", F.format_string("X%07d", n))
        .when(kind == "MEDICAL_LICENSE", F.format_string("XX%07d", n))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )


def surrogates(kept: Column, days: Column) -> Column:
    """Values of the disjoint spans: the same text has the same value, numbered from the right.

    Dates move by the document's offset. The type of a text is that of its right-most span.
    """
    back = F.reverse(kept)
    names = F.array_distinct(F.transform(back, lambda e: e["text"]))

    def value(e: Column) -> Column:
        kind = F.element_at(F.filter(back, lambda x: x["text"] == e["text"]), 1)["entity_type"]
        return F.when(kind == "DATE_TIME", shift(e["text"], days)).otherwise(synthetic(kind, F.array_position(names, e["text"]).cast("int")))

    return F.transform(kept, value)


def review_flags(text: Column, name: Column, spans: Column) -> Column:
    """What a person should look at: spans of medium score with 60 characters around."""
    medium = F.filter(spans, lambda e: (e["score"] >= LOW) & (e["score"] < HIGH))
    start = lambda e: F.greatest(e["start"] - CONTEXT, F.lit(0))
    return F.transform(
        medium,
        lambda e: F.struct(
            name.alias("file"), e["entity_type"].alias("entity_type"), e["text"].alias("original_text"), F.bround(e["score"], 3).alias("confidence"),
            F.substring(text, start(e) + 1, F.least(e["end"] + CONTEXT, F.length(text)) - start(e)).alias("context"),
            F.lit("redacted_pending_review").alias("action"),
        ),
    )
