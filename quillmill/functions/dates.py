"""Dates in running text: a fixed offset per document, shifted and written in the style of the original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.once import let

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: The eight styles in the order in which they are tried: a pattern, and the format it is parsed with.
STYLES = {
    "month_day_year": (rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", "MMMM d yyyy"),
    "short_day_year": (rf"(?i)\b(?:{SHORT})\.?\s+\d{{1,2}},?\s+\d{{4}}\b", "MMM d yyyy"),
    "iso": (r"\b\d{4}-\d{2}-\d{2}\b", "yyyy-MM-dd"),
    "slash": (r"\b\d{1,2}/\d{1,2}/\d{4}\b", "M/d/yyyy"),
    "dash": (r"\b\d{2}-\d{2}-\d{4}\b", "MM-dd-yyyy"),
    "day_month_year": (rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b", "d MMMM yyyy"),
    "month_year": (rf"(?i)\b(?:{MONTHS})\s+\d{{4}}\b", "MMMM yyyy"),
    "short_year": (rf"(?i)\b(?:{SHORT})\.?\s+\d{{4}}\b", "MMM yyyy"),
}
LEAST, SPAN, PREFIX = 180, 551, 4096


def offset_days(text: Column) -> Column:
    """180 to 730, from the SHA-256 of the first 4,096 characters taken modulo 551 digit by digit."""
    digits = F.split(F.sha2(F.substring(text, 1, PREFIX), 256), "")
    value = lambda d: F.conv(d, 16, 10).cast("int")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: (a * 16 + value(d)) % SPAN) + LEAST


def style_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(STYLES.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def parse(text: Column) -> Column:
    """The date of the first style that fits; a missing day is the first. Null where there is none."""
    out = F.lit(None).cast("date")
    for pattern, fmt in reversed(STYLES.values()):
        hit = F.regexp_extract(text, f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})", 1)
        plain = F.initcap(F.regexp_replace(F.regexp_replace(hit, "[.,]", " "), r"\s+", " "))
        out = F.when(text.rlike(pattern), F.try_to_timestamp(plain, F.lit(fmt)).cast("date")).otherwise(out)
    return out


_NAMES = MONTHS.lower().split("|")
#: Two digits up to this are years of the 2000s.
PIVOT = 68


def fuzzy(text: Column) -> Column:
    """The date that stands in loose wording, or null.

    Words and numbers go through one fold that keeps the month, the day, the year and the numbers not yet placed: names of months and their
    beginnings of three letters or more, days with an ordinal's ending, years of four digits, of two behind an apostrophe or in the last
    place, eight digits at once; everything else is noise, and so are times. Of numbers alone the first is the month unless it cannot be
    one or the year stands in front. A missing day is the first; where the month or the year is missing, or two of a kind stand there, there is no date.
    """
    plain = F.regexp_replace(F.lower(text), r"\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\b\.?)?", " ")
    tokens = F.regexp_extract_all(plain, F.lit(r"[a-z]+|\d+|['’]"), F.lit(0))
    names = F.array(*[F.lit(n[:3]) for n in _NAMES])
    full = F.array(*map(F.lit, _NAMES))
    start = F.expr("named_struct('m', cast(null as int), 'd', cast(null as int), 'y', cast(null as int), 'nums', cast(array() as array<int>), 'lead', false, 'before', '', 'bad', false)")

    def state(a, before, **new):
        fields = {c: a[c] for c in ("m", "d", "y", "nums", "lead", "bad")} | new
        order = ("m", "d", "y", "nums", "lead")
        return F.struct(*[fields[c].alias(c) for c in order], before.alias("before"), fields["bad"].alias("bad"))

    def step(a: Column, t: Column) -> Column:
        number = F.try_to_number(t, F.lit("99999999")).cast("int")
        digits = F.when(t.rlike("^[0-9]"), F.length(t)).otherwise(0)
        place = F.array_position(names, F.substring(t, 1, 3)).cast("int")
        month = (F.length(t) >= 3) & (place > 0) & (F.startswith(F.get(full, place - 1), t) | (t == "sept"))
        last = F.element_at(F.concat(F.array(F.lit(0)), a["nums"]), -1)
        ordinal = t.isin("st", "nd", "rd", "th") & a["before"].rlike("^[0-9]{1,2}$")
        short = F.when(number <= PIVOT, number + 2000).otherwise(number + 1900)
        return (
            F.when(month, state(a, t, m=place, bad=a["bad"] | a["m"].isNotNull()))
            .when(ordinal, state(a, t, d=last, nums=F.slice(a["nums"], F.lit(1), F.greatest(F.size(a["nums"]) - 1, F.lit(0))), bad=a["bad"] | a["d"].isNotNull()))
            .when(digits == 4, state(a, t, y=number, lead=F.size(a["nums"]) == 0, bad=a["bad"] | a["y"].isNotNull()))
            .when(digits == 8, state(a, t, y=F.floor(number / 10000).cast("int"), m=(F.floor(number / 100) % 100).cast("int"), d=number % 100, bad=a["bad"] | a["y"].isNotNull()))
            .when((digits == 2) & a["before"].isin("'", "’"), state(a, t, y=short, bad=a["bad"] | a["y"].isNotNull()))
            .when(digits.isin(1, 2), state(a, t, nums=F.concat(a["nums"], F.array(number))))
            .otherwise(state(a, t))
        )

    def made(a: Column) -> Column:
        n = F.size(a["nums"])
        one, two, three = (F.get(a["nums"], F.lit(i)) for i in range(3))
        short = lambda x: F.when(x <= PIVOT, x + 2000).otherwise(x + 1900)
        turned = ~a["lead"] & (one > 12)
        by_name = F.struct(a["m"].alias("m"), F.coalesce(a["d"], F.when(n > 0, one), F.lit(1)).alias("d"), F.coalesce(a["y"], short(F.when(a["d"].isNull(), two).otherwise(one))).alias("y"))
        by_number = F.struct(
            F.when(turned & (n >= 2), two).otherwise(one).alias("m"), F.coalesce(a["d"], F.when(turned, one).otherwise(two), F.lit(1)).alias("d"),
            F.coalesce(a["y"], short(F.when(n == 3, three))).alias("y"),
        )
        left = n - F.when(a["m"].isNotNull(), a["d"].isNull().cast("int") + a["y"].isNull().cast("int")).otherwise(F.when(a["y"].isNull(), 3).otherwise(2))
        x = F.when(a["m"].isNotNull(), by_name).otherwise(by_number)
        at = let(x, lambda x: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"]), F.lit("yyyy-MM-dd")).cast("date"))
        return F.when(~a["bad"] & (left <= 0), at)

    return F.aggregate(tokens, start, step, made)


def write(style: Column, day: Column, original: Column) -> Column:
    """A date in a style; dots, and zeros in front of slashed numbers, as in the original."""
    fmt = lambda f: F.date_format(day, f)
    slashed = lambda k, name: F.when(
        F.length(F.regexp_extract(original, r"(\d{1,2})/(\d{1,2})/(\d{4})", k)) == 2, fmt(name * 2)
    ).otherwise(fmt(name))
    year = F.year(day).cast("string")
    return (
        F.when(style == "month_day_year", F.concat(fmt("MMMM"), F.lit(" "), fmt("d"), F.lit(", "), year))
        .when(style == "short_day_year", F.concat(fmt("MMM"), F.when(F.contains(original, F.lit(".")), ".").otherwise(""), F.lit(" "), fmt("d"), F.lit(", "), year))
        .when(style == "slash", F.concat_ws("/", slashed(1, "M"), slashed(2, "d"), year))
        .when(style == "dash", F.concat_ws("-", fmt("MM"), fmt("dd"), year))
        .when(style == "day_month_year", F.concat_ws(" ", fmt("d"), fmt("MMMM"), year))
        .when(style == "month_year", F.concat_ws(" ", fmt("MMMM"), year))
        .when(style == "short_year", F.concat_ws(" ", fmt("MMM"), year))
        .otherwise(F.concat_ws("-", year, fmt("MM"), fmt("dd")))
    )


def shift(text: Column, days: Column) -> Column:
    """The text's date that many days later; a text without a date as it is.

    It is written in the first style that fits, in loose wording as an ISO date. What is no style's by itself is parsed as loose wording
    first, so a day in front of a month and its year counts.
    """
    whole = "|".join(p.replace("(?i)", "") for p, _ in STYLES.values())
    day = F.when(text.rlike(f"(?i)^(?:{whole})$"), parse(text)).otherwise(F.coalesce(fuzzy(text), parse(text)))
    return let(F.date_add(day, days), lambda d: F.when(d.isNull(), text).otherwise(write(style_of(text), d, text)))
