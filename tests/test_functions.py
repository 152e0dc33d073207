import datetime
import re
from collections import Counter

from pyspark.sql import functions as F

from quillmill.functions import caselaw, chunks, classify, dates, naming, spans, targets, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


def plain_clean(t):
    """The same rules in plain Python."""
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = "\n".join("" if re.search("Thomson Reuters|LexisNexis|Westlaw", x) else x for x in t.split("\n"))
    t = re.sub(r"(?m)^\s*\d{1,3}\s{1,3}(?=\S)", "", t)
    for a, b in {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "..."}.items():
        t = t.replace(a, b)
    lines = [x.rstrip() for x in t.split("\n")]
    often = {x for x, n in Counter(x.strip() for x in lines).items() if n >= 3 and 0 < len(x) < 80}
    t = "\n".join(x for x in lines if x.strip() not in often)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", t))).strip()


def test_clean_follows_the_rules(spark):
    cases = [
        "a\r\nb\rc", "x\n\n\n\ny", "1  first\n 12 second\n3\nthird", "“q” – ‘s’ — …", "H\na\nH\nb\n H \nc", "H\na\nH\nb", "L" * 80 + "\n" + "L" * 80 + "\n" + "L" * 80,
        "see Westlaw here\nnext", "see westlaw here", "a \nb ", "a  b\t\tc", "", " 1 x", "5 é",
    ]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.clean(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in got} == {i: plain_clean(c) for i, c in enumerate(cases)}


def test_clean_keeps_null(spark):
    assert one(spark, text.clean(F.col("t")), t=None) is None


def test_sample_of_long_text(spark):
    t = "a" * 9000 + "b" * 9000 + "c" * 9000
    got = one(spark, text.sample_segments(F.col("t")), t=t)
    assert got.startswith("a" * 8000 + "\n\n[") and got.endswith("]\n\n" + "c" * 8000) and t[9500:17500] in got
    assert one(spark, text.sample_segments(F.col("t")), t="x" * 24000) == "x" * 24000


CASELAW = "UNITED STATES COURT OF APPEALS\nSEVENTH CIRCUIT\n\nSmith v. Jones, 123 F.3d 456\n(7th Cir. 2019)\n\nOPINION\nThe plaintiff appealed."


def classified(spark, ext, t):
    row = spark.createDataFrame([(ext, t)], "ext string, raw string")
    return tuple(row.select(classify.classification(F.col("ext"), classify.raw_scores(F.col("raw"))).alias("c")).first()["c"])


def test_classification(spark):
    kind, confidence = classified(spark, ".txt", CASELAW)
    assert kind == "caselaw" and abs(confidence - 0.70 / 1.05) < 1e-12
    assert classified(spark, ".txt", "Vol. 42, No. 3\nISSN: 0019-1876\nBar Journal") == ("published", 1.0)
    assert classified(spark, ".txt", "To: Jane\nDear Sir")[0] == "private"
    assert classified(spark, ".txt", "nothing here") == ("uncertain", 0.0)
    assert classified(spark, ".eml", CASELAW) == ("private", 0.99) and classified(spark, ".pptx", "") == ("published", 0.90)
    # a tie is no decision, and only the first 5,000 characters count
    assert classified(spark, ".txt", "PER CURIAM ISSN: 12")[0] == "uncertain"
    assert classified(spark, ".txt", "x" * 5000 + " OPINION") == ("uncertain", 0.0)


def test_date_offset_and_styles(spark):
    assert one(spark, dates.offset_days(F.col("t")), t="hello world") == 531
    day = datetime.date(2024, 3, 15) + datetime.timedelta(days=200)
    want = {
        "March 15, 2024": f"{day:%B} {day.day}, {day.year}", "Mar. 15, 2024": f"{day:%b}. {day.day}, {day.year}", "2024-03-15": f"{day:%Y-%m-%d}",
        "3/15/2024": f"{day.month:02d}/{day.day:02d}/{day.year}".lstrip("0"), "03-15-2024": f"{day:%m-%d-%Y}", "15 March 2024": f"{day.day} {day:%B} {day.year}", "no date": "no date",
        "March 2024": (datetime.date(2024, 3, 1) + datetime.timedelta(days=200)).strftime("%B %Y"),
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", dates.shift(F.col("t"), F.lit(200)).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == want


def test_spans_offsets_count_code_points(spark):
    t = "é😀 mail a@b.com and 123-45-6789"
    got = spark.createDataFrame([(t,)], "t string").select(spans.found(F.col("t")).alias("s")).first()["s"]
    assert {(s["entity_type"], t[s["start"] : s["end"]]) for s in got} == {("EMAIL_ADDRESS", "a@b.com"), ("US_SSN", "123-45-6789")}


def test_overlaps_keep_the_earliest_and_longest(spark):
    rows = "array(" + ",".join(f"named_struct('entity_type','T','start',{a},'end',{b},'score',0.9D,'text','{a}')" for a, b in ((5, 12), (0, 4), (10, 14), (0, 10))) + ")"
    got = spark.sql(f"select {rows} as s").select(spans.disjoint(F.col("s")).alias("k")).first()["k"]
    assert [(e["start"], e["end"]) for e in got] == [(0, 10), (10, 14)]


def test_targets(spark):
    assert one(spark, targets.parts(F.col("t")), t="Dr. A / Bcd; Cde (also Def)/") == ["Dr. A", "Bcd", "Cde", "Def"]
    assert one(spark, targets.token_for(F.col("t")), t=" Facility/Address ") == "[ADDRESS]" and one(spark, targets.token_for(F.col("t")), t="new") == "[REDACTED]"
    pats = [(one(spark, targets.pattern(F.col("t")), t=v), tok) for v, tok in (("John Smith", "[PERSON]"), ("person", "[REDACTED]"), ("$5", "a$1\\"))]
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(p).alias("p"), targets.quoted(F.lit(t)).alias("t")) for i, (p, t) in enumerate(pats)])
    got = one(spark, targets.applied(F.col("t"), listed), t="John Smith sued JOHN SMITH. $5 person")
    assert (got["text"], got["n"]) == ("[[REDACTED]] sued [[REDACTED]]. a$1\\ [REDACTED]", 6)


def test_names(spark):
    stem = lambda n: one(spark, naming.canonical_stem(F.col("t")), t=n)
    assert [stem(n) for n in ("A.ocr.pdf", "a-OCR.pdf", "b searchable copy.pdf", " c .txt", ".hidden")] == ["a", "a", "b", "c", ".hidden"]
    assert one(spark, naming.slug(F.col("t")), t="Smith v. Jones (1).pdf") == "smith_v_jones_1"
    assert one(spark, naming.extension(F.col("t")), t="x.PDF") == ".pdf"


def test_caselaw_metadata(spark):
    got = one(spark, caselaw.metadata(F.col("t")), t=CASELAW)
    assert got["citation"].endswith("Smith v. Jones, 123 F.3d 456") and got["year"] is None and got["court"] == "7th Cir."
    assert one(spark, caselaw.metadata(F.col("t")), t="(2019) and (Ill. 2001)")["year"] == 2019


def test_splitter_keeps_its_promises():
    sentence = "The court held that the motion is denied. "
    s = chunks.Splitter(512, 64, chunks.LEGAL_SEPARATORS)
    parts = s.split(sentence * 300)
    assert len(parts) > 1 and all(chunks.word_tokens(p) <= 512 for p in parts)
    assert chunks.Splitter(2048, 128, chunks.COMMON_SEPARATORS).split(sentence * 20) == [(sentence * 20).strip()]
    # an overlap repeats the end of a chunk, and nothing is lost
    words = [f"w{i}" for i in range(5000)]
    parts = chunks.Splitter(100, 20, chunks.COMMON_SEPARATORS).split(" ".join(words))
    assert [w for w in dict.fromkeys(x for p in parts for x in p.split())] == words
    assert all(0 < len(set(a.split()) & set(b.split())) <= 20 for a, b in zip(parts, parts[1:]))
    assert chunks.Splitter(10, 2, chunks.COMMON_SEPARATORS).split("") == []


def test_chunks_of_null_and_empty(spark):
    rows = spark.createDataFrame([(None, "private"), ("", "caselaw"), ("a b", "other")], "t string, k string")
    got = [r["c"] for r in rows.select(chunks.chunked(F.col("t"), F.col("k")).alias("c")).collect()]
    assert got[0] is None and [(c["text"], c["total"]) for c in got[1]] == [("", 1)] and got[2][0]["token_count"] == 2
