"""Quasi-identifiers as replacement targets: splitting, tokens, patterns and replacement in sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK = "[REDACTED]"
#: Types of quasi-identifiers by replacement token. A type named twice belongs to the later token.
TYPES = {
    "[PERSON]": [
        "patient_name", "patient_name_alt", "full_name", "name", "plaintiff_name", "plaintiff", "patient_surname", "surname_in_text", "mother_name",
        "parent", "treating_physician", "crew_names", "crew_names_and_licenses", "clinician names", "deponent_details", "individual_defendant",
        "attorney_names_and_firms", "clerk_name",
    ],
    "[ORGANIZATION]": [
        "facility", "facility_name", "facility_pair", "facility/address", "facility identifiers", "facility_code", "hospital_facility",
        "defendant_entity", "defendant_entities", "defendant_name", "provider_name", "provider/company", "ambulance_company_and_run", "requester address",
    ],
    "[CASE_NO]": ["case_number", "docket_number", "court/docket", "case_caption", "case caption", "case_caption_marker", "exhibit_marking", "court", "court/venue", "court_venue"],
    "[DATE]": ["date_of_birth", "dob", "date of request", "date_signed", "date_range", "date_of_service", "incident_date", "incident_date_time", "filing_date"],
    "[ADDRESS]": ["address", "home_address", "geographic anchor", "geographic_anchor", "geography", "address_in_clinical_note", "facility/address"],
    "[ID_NUMBER]": ["mrn", "medical_record_number", "fin/account", "account_numbers", "incident_number", "firm_number", "ardc_number", "anesthesiologist id", "anesthesiologist_id"],
    "[SSN]": ["ssn", "ssn_fragment", "credit_card_holder"],
    "[EMAIL]": ["email"],
    "[CITATION]": ["citation"],
}
TOKEN_OF = {kind: token for token, kinds in TYPES.items() for kind in kinds}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def token_for(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TOKEN_OF.items() for x in pair])
    return F.coalesce(table[strip(F.lower(kind))], F.lit(FALLBACK))


def parts(value: Column) -> Column:
    """A value's parts between slashes, semicolons and "(also", of three characters or more."""
    cut = F.split(strip(F.coalesce(value, F.lit(""))), r"\s*[/;]\s*|\s*\(also\s*", -1)
    return F.filter(F.transform(cut, lambda p: F.regexp_replace(strip(p), r"\)+$", "")), lambda p: F.length(p) >= 3)


def usable(value: Column) -> Column:
    """Not empty, not over 300 characters, no description and no bare year."""
    return (
        (F.length(value) > 0) & (F.length(value) <= 300) & ~F.startswith(value, F.lit("(")) & ~F.contains(value, F.lit("→"))
        & ~F.startswith(value, F.lit("e.g.")) & ~value.rlike(r"^\d{4}$")
    )


def pattern(value: Column) -> Column:
    """The value literally, in any case, as a whole word where it starts or ends with a word's character."""
    literal = F.regexp_replace(value, r"(?U)([^\w\s])", r"\\$1")
    left = F.when(value.rlike(r"(?U)^\w"), r"\b").otherwise("")
    right = F.when(value.rlike(r"(?U)\w$"), r"\b").otherwise("")
    return F.concat(F.lit("(?iu)"), left, literal, right)


def _folds() -> tuple[str, str]:
    """Characters whose lower case is not that of their upper case (such as the long s), and what that is; the dot of a lowered İ goes."""
    odd = [c for c in map(chr, range(0x110000)) if c.islower() and len(c.upper()) == len(c.upper().lower()) == 1 and c.upper().lower() != c]
    return "".join(odd) + "\u0307", "".join(c.upper().lower() for c in odd)


FOLDED_FROM, FOLDED_TO = _folds()


def words(text: Column) -> Column:
    """Runs of word characters in one form for all cases, so that words that :func:`pattern` takes as equal are equal."""
    return F.regexp_extract_all(F.translate(F.lower(text), FOLDED_FROM, FOLDED_TO), F.lit(r"(?U)\w+"), F.lit(0))


def quoted(token: Column) -> Column:
    """The token as a replacement that stands for itself."""
    return F.replace(F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def unquoted(token: Column) -> Column:
    return F.regexp_replace(token, r"\\(.)", "$1")


def applied(text: Column, targets: Column) -> Column:
    """``struct<text, n>``: the ``array<struct<place, p, t>>`` one after another, each on what the one before left.

    A later value can match inside an earlier token; the count is of all replacements.
    """
    return F.aggregate(
        targets, F.struct(text.alias("text"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.regexp_replace(a["text"], x["p"], x["t"]).alias("text"), (a["n"] + F.regexp_count(a["text"], x["p"])).alias("n")),
    )
