"""A corpus with every signal the operators look for, made from ``documents`` by a fixed rule.

The rule is stated twice, once for each engine, so a query over it can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.naming import extension, filename
from quillmill.sources.shared import dealt

HEADERS = (
    "UNITED STATES COURT OF APPEALS\nSEVENTH CIRCUIT\n\nSmith v. Jones, 123 F.3d 456\n(7th Cir. 2019)\n\nOPINION\n\n",
    "Illinois Bar Journal\nVol. 42, No. 3\nISSN: 0019-1876\n\n",
    "To: Jane Roe\nFrom: John Doe\nATTORNEYS FOR PLAINTIFF\nSSN 123-45-6789, filed March 15, 2024, again 3/5/2024 and 2024-03-15.\n\n",
    "",
)
#: (modulus, text behind the document where its id is divisible)
TAILS = (
    (5, "\nSource: Westlaw database line\nend of source"),
    (6, "\nCall (312) 555-0100 or mail jane@example.com at 10.0.0.7, again jane@example.com."),
    (7, "\n  12  numbered line\n3 another line"),
    (8, "\n“quoted” — it’s – done…  \nnext  line\t\tthere"),
    (9, "\n\n\n\nafter a gap"),
    (10, "\nPage header\none\nPage header\ntwo\n  Page header \nthree"),
    (12, "\nPassport no. 123456789, account number: 0012345678, driver's license D1234567, DEA number AB1234563. Mrs. Ada Byron of 12 Elm Street."),
    (11, "\r\nwith CRLF\rand CR"),
)
#: (modulus, remainder, name format): the first that fits names the file; numbers are of groups of five.
NAMES = (
    (13, 0, "mail_%d.msg"), (11, 0, "deck_%d.pptx"), (5, 0, "case_%d.txt"), (5, 1, "case_%d.ocr.pdf"), (5, 2, "Case_%d.pdf"), (5, 3, "sub/case_%d_ocr.docx"), (5, 4, "note_%d.eml"),
)


def _sql(s: str) -> str:
    """A DuckDB literal with its control characters by number."""
    out = "'" + s.replace("'", "''") + "'"
    for c in "\r\n\t":
        out = out.replace(c, f"'||chr({ord(c)})||'")
    return out.replace("||''||", "||")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, filename, ext, raw, sha256, ocr, ocr_confidence``."""
    docs = documents(spark, sf_dir)
    i = F.col("doc_id")
    head = F.lit(HEADERS[-1])
    for k, h in enumerate(HEADERS[:-1]):
        head = F.when(i % len(HEADERS) == k, F.lit(h)).otherwise(head)
    raw = F.concat(head, F.coalesce("text", F.lit("")), *[F.when(i % m == 0, F.lit(t)).otherwise("") for m, t in TAILS])
    name = F.lit(None).cast("string")
    for m, r, f in reversed(NAMES):
        name = F.when(i % m == r, F.format_string(f.replace("%d", "%s"), F.floor(i / 5).cast("string"))).otherwise(name)
    path = F.concat(F.lit("in/"), (i % 3).cast("string"), F.lit("/"), name)
    return docs.select(
        "doc_id", path.alias("path"), filename(path).alias("filename"), extension(filename(path)).alias("ext"), raw.alias("raw"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), (i % 5 == 1).alias("ocr"), F.when(i % 5 == 1, 60.0 + i % 40).alias("ocr_confidence"),
    )


_HEAD = "CASE " + " ".join(f"WHEN doc_id % {len(HEADERS)} = {k} THEN {_sql(h)}" for k, h in enumerate(HEADERS)) + " END"
_TAIL = " || ".join(f"CASE WHEN doc_id % {m} = 0 THEN {_sql(t)} ELSE '' END" for m, t in TAILS)
_NAME = "CASE " + " ".join(f"WHEN doc_id % {m} = {r} THEN replace('{f}', '%d', CAST(doc_id // 5 AS VARCHAR))" for m, r, f in NAMES) + " END"
#: Common table expressions for DuckDB: ``corpus`` with the columns above.
CORPUS = f"""named AS (SELECT doc_id, coalesce(text, '') AS body, 'in/' || (doc_id % 3) || '/' || {_NAME} AS path FROM documents),
corpus AS (SELECT doc_id, path, string_split(path, '/')[-1] AS filename, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS ext,
 {_HEAD} || body || {_TAIL} AS raw, sha256(body) AS sha256, doc_id % 5 = 1 AS ocr, CASE WHEN doc_id % 5 = 1 THEN 60.0::DOUBLE + doc_id % 40 END AS ocr_confidence FROM named)"""

#: DuckDB macros as text: the steps of cleaning on an expression.
def clean_sql(x: str) -> dict[str, str]:
    """Expressions of each step on the column named; each names the step before as a column of that name."""
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    rep = "list_filter(lines, lambda a: NOT (len(" + strip.format("a") + ") > 0 AND len(" + strip.format("a") + ") < 80 AND len(list_filter(lines, lambda b: " + strip.format("b") + " = " + strip.format("a") + ")) >= 3))"
    return {
        "newlines": f"replace(replace({x}, chr(13)||chr(10), chr(10)), chr(13), chr(10))",
        "annotations": r"regexp_replace(newlines, '(?m)^[^\n]*(?:Thomson Reuters|LexisNexis|Westlaw)[^\n]*$', '', 'g')",
        "numbers": r"regexp_replace(annotations, '(?m)^\s*\d{1,3}\s{1,3}(\S)', '\1', 'g')",
        "typography": "replace(replace(translate(numbers, '‘’“”–', '''''\"\"-'), '—', '--'), '…', '...')",
        "lines": r"list_transform(string_split(typography, chr(10)), lambda a: regexp_replace(a, '\s+$', ''))",
        "kept": f"array_to_string({rep}, chr(10))",
        "clean": strip.format(r"regexp_replace(regexp_replace(regexp_replace(kept, '\n{3,}', chr(10)||chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10)||chr(10), 'g')"),
    }


def cleaned_sql(source: str = "corpus", column: str = "raw") -> str:
    """CTEs ``c0 ... cleaned`` that add every step to the source's columns."""
    steps = clean_sql(column)
    out, last = [], source
    for k, (name, expr) in enumerate(steps.items()):
        target = "cleaned" if name == "clean" else f"clean_{k}"
        out.append(f"{target} AS (SELECT *, {expr} AS {name} FROM {last})")
        last = target
    return ",\n".join(out)
