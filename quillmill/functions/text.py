"""Text normalisation as Column functions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.once import let

# What a line of a legal database holds, and how a numbered line of a pleading starts.
ANNOTATION = r"(?md)^[^\n]*(?:Thomson Reuters|LexisNexis|Westlaw)[^\n]*$"
LINE_NUMBER = r"(?mdU)^\s*\d{1,3}\s{1,3}(?=\S)"
#: Unicode white space at the ends, as Python's strip() sees it.
_ENDS = r"(?U)^\s+|\s+$"
#: The same behind and in front of each line; a run of blanks is tried at its first one only.
_BLANK = r"[\s&&[^\n]]"
_BEHIND = rf"(?U){_BLANK}(?<!{_BLANK}{_BLANK}){_BLANK}*+(?=\n|\z)"
_FRONT = rf"(?Umd)^{_BLANK}++"


def strip(text: Column) -> Column:
    return let(text, lambda t: F.when(F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(r"(?U)\s"), F.regexp_replace(t, _ENDS, "")).otherwise(t))


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def blank_annotations(text: Column) -> Column:
    """Lines that name a legal database become empty lines; the names are case-sensitive."""
    named = lambda t: F.contains(t, F.lit("Thomson Reuters")) | F.contains(t, F.lit("LexisNexis")) | F.contains(t, F.lit("Westlaw"))
    return let(text, lambda t: F.when(named(t), F.regexp_replace(t, ANNOTATION, "")).otherwise(t))


def strip_line_numbers(text: Column) -> Column:
    """Leading numbers of pleadings go, with blank lines in front of them."""
    return F.regexp_replace(text, LINE_NUMBER, "")


def typography(text: Column) -> Column:
    """Typographic quotes, dashes and ellipses become ASCII."""
    def plain(t: Column) -> Column:
        for raw, ascii_ in zip("‘’“”–—…", ("'", "'", '"', '"', "-", "--", "...")):
            t = F.replace(t, F.lit(raw), F.lit(ascii_))
        return t

    return let(text, lambda t: F.when(t.rlike("[–-…]"), plain(t)).otherwise(t))  # one range that holds them all is found soonest


def repeated_lines(lines: Column) -> Column:
    """Of stripped lines those of under 80 characters that occur three times or more, sorted.

    A sorted array holds a third copy two places behind the first, so one pass finds them; it is sorted once, and only where lines repeat.
    """

    def thirds(ordered: Column) -> Column:
        third = F.transform(ordered, lambda s, i: F.when((i >= 2) & (F.get(ordered, i - 2) == s), s))
        return F.array_distinct(F.filter(third, lambda s: s.isNotNull()))

    short = F.filter(lines, lambda s: (F.length(s) > 0) & (F.length(s) < 80))
    none = F.expr("cast(array() as array<string>)")
    return let(short, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), none).otherwise(let(F.sort_array(s), thirds)))


def drop_repeated_lines(text: Column) -> Column:
    """All occurrences of repeated short lines go; blank lines stay. Trailing white space of lines goes first."""
    bare = lambda t: F.regexp_replace(t, _FRONT, "")
    left = lambda t, gone: F.array_join(F.filter(F.split(t, "\n", -1), lambda s: ~F.array_contains(gone, bare(s))), "\n")
    dropped = lambda t: let(repeated_lines(F.split(bare(t), "\n", -1)), lambda gone: F.when(F.size(gone) == 0, t).otherwise(left(t, gone)))
    return let(F.regexp_replace(text, _BEHIND, ""), dropped)


def collapse(text: Column) -> Column:
    """Three or more line ends become two and runs of blanks one, then line ends again."""
    ends = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    blanks = lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, r"[ \t]{2,}", " ")).otherwise(t)
    return let(let(let(text, ends), blanks), ends)


def clean(text: Column) -> Column:
    """The whole normalisation, in its fixed order. Null stays null."""
    for step in (newlines, blank_annotations, strip_line_numbers, typography, drop_repeated_lines, collapse, strip):
        text = step(text)
    return text


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def thousands(n: Column) -> Column:
    """Whole numbers with commas."""
    return F.format_number(n, 0)


def one_place(x: Column) -> Column:
    return F.format_string("%.1f", x.cast("double"))


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


SEGMENT = 8_000


def sample_segments(text: Column, segment: int = SEGMENT) -> Column:
    """A text of over three segments as its first, middle and last one with marks between."""
    n = F.length(text)
    middle = F.substring(text, F.floor((n - segment) / 2).cast("int") + 1, F.lit(segment))
    joined = F.concat(
        F.substring(text, 1, segment), F.lit("\n\n[… middle of document omitted …]\n\n"),
        middle, F.lit("\n\n[… end of document follows …]\n\n"), F.substring(text, n - segment + 1, F.lit(segment)),
    )
    return F.when(n <= 3 * segment, text).otherwise(joined)
