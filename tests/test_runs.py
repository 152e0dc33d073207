"""Whole runs over a folder, and what large inputs change inside operators."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill import __main__ as commands
from quillmill import runs, service
from quillmill.functions import register, spans
from quillmill.functions import targets as T
from quillmill.functions.automaton import Automaton
from quillmill.operators import second_pass
from quillmill.sources import snapshots, tables
from quillmill.sources.shared import ordinal, spread

LETTER = "To: x\nSSN 123-45-6789 and (312) 555-0100. Passport no. 123456789. Mrs. Ada Byron of 12 Elm Street."


@pytest.fixture(scope="module")
def case(tmp_path_factory):
    folder = tmp_path_factory.mktemp("case")
    for name, text in {"letter.txt": LETTER, "copy.txt": LETTER, "opinion.txt": "Smith v. Jones, 1 F.3d 2 OPINION", "scan.pdf": "x"}.items():
        (folder / name).write_text(text)
    return folder


def scanned(content):
    return F.struct(F.lit("text").alias("text"), F.lit(12.0).alias("confidence"))


def test_a_run_its_review_and_its_second_pass(spark, case, tmp_path, capsys):
    out = str(tmp_path / "out")
    dry = runs.process_folder(spark, str(case), out, dry_run=True, ocr=scanned).collect()
    assert not (tmp_path / "out").exists()
    rows = {r["filename"]: r for r in runs.process_folder(spark, str(case), out, ocr=scanned).collect()}
    assert set(rows) == {r["filename"] for r in dry} == {"copy.txt", "opinion.txt", "scan.pdf"}
    assert rows["scan.pdf"]["doc_type"] == "unknown" and rows["scan.pdf"]["skipped"] and rows["scan.pdf"]["token_count"] == 0
    assert (tmp_path / "out/review/ocr_queue/scan.pdf").read_text() == "x"
    kinds = {r["entity_type"] for r in tables.review_log(spark, f"{out}/review/log").collect()}
    assert kinds == {"PHONE_NUMBER", "US_PASSPORT"}
    manifest = {r["original_filename"]: r for r in tables.manifest_files(spark, out).collect()}
    assert len(manifest) == 3 and manifest["copy.txt"]["sha256"] and manifest["scan.pdf"]["skip_reason"] == "ocr_confidence_low"
    assert commands.main(["review-pii", "--log", f"{out}/review/log", "--summary"]) == 0 and "PHONE_NUMBER" in capsys.readouterr().out
    assert commands.main(["process", "--input", str(tmp_path / "none"), "--output", out]) == 1
    ranks = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    assert commands.main(["process", "--input", str(case), "--output", out, "--dry-run", "--patterns-only", "--vocabulary", ranks]) == 0

    assert service.answer(spark, out, "GET", "/status")[0] == 200 and "PHONE_NUMBER" in service.answer(spark, out, "GET", "/")[2]
    assert json.loads(service.answer(spark, out, "GET", "/provenance")[2])["total_files"] == 3 and service.answer(spark, out, "GET", "/x")[0] == 404
    restore = {"flag_id": 0, "file": "copy.txt", "entity_type": "PHONE_NUMBER", "original_text": "(312) 555-0100", "confidence": 0.75, "decision": "restore"}
    said = json.loads(service.answer(spark, out, "POST", "/apply", json.dumps({"decisions": [restore], "reviewer": "R"}).encode())[2])
    assert said["restored_original"] == 1 and said["files_reprocessed"] == 1
    assert "(312) 555-0100" in tables.finetune(spark, f"{out}/finetune").first()["text"]
    assert "(312) 555-0100" not in tables.jsonl(spark, f"{out}/finetune", tables.FINETUNE, 0).first()["text"]
    assert not tables.review_log(spark, f"{out}/review/log").where("entity_type = 'PHONE_NUMBER'").count()

    response = json.dumps({"risk_level": "HIGH", "quasi_identifiers": [{"type": "name", "value": "Example Street"}], "additional_redactions": []})
    runs.assess(spark, out, lambda records: records.withColumn("response", F.lit(response)), model="stored")
    assert commands.main(["second-pass", "--output", out, "--dry-run"]) == 0 and snapshots.latest(spark, f"{out}/finetune") == 1
    assert commands.main(["second-pass", "--output", out, "--quiet"]) == 0
    assert snapshots.versions(spark, f"{out}/finetune") == [1, 2]
    assert "Example Street" not in tables.finetune(spark, f"{out}/finetune").first()["text"]
    audit = spark.read.json(f"{out}/audit/second_pass_redactions").first()
    assert audit["terms_applied"] == 1 and audit["files_patched"] == ["finetune"]


@pytest.mark.parametrize("tokens", [["[PERSON]", "[REDACTED]", "$1 \\\\ x"], ["[PERSON]", "net", "<x", "Ann-"]])
def test_targets_that_matter_give_what_all_give_one_by_one(spark, monkeypatch, tokens):
    rnd = random.Random(4)
    words = ["Ann", "bob", "COST", "straße", "STRASSE", "person", "net", "x-y", "$5", "(net)", "[PERSON]", "redacted", "Ķīna", "naïve", "ſet", "a_b", "12"]
    phrase = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, n)))
    values = sorted({phrase(3) for _ in range(60)}, key=lambda v: (-len(v), v))
    found = spark.createDataFrame([(v, rnd.choice(tokens), i) for i, v in enumerate(values, 1)], "value string, token string, place int")
    texts = [phrase(12).upper() if i % 3 else phrase(12) for i in range(80)] + [None, ""]
    records = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "line_no int, text string")
    listed = found.select(F.array_sort(F.collect_list(F.struct("place", T.pattern(F.col("value")).alias("p"), T.quoted(F.col("token")).alias("t"))).over(Window.partitionBy(F.lit(1)))).alias("all")).limit(1)
    a = T.applied(F.coalesce("text", F.lit("")), F.col("all"))
    few = sorted(tuple(r) for r in records.join(F.broadcast(listed), F.lit(True)).select("line_no", a["text"], a["n"]).collect())
    assert sorted(tuple(r) for r in second_pass.applied(records, found).collect()) == few
    seen = sorted(tuple(r) for r in second_pass.preview(records, found).collect())
    monkeypatch.setattr(second_pass, "PART_BYTES", 2500)
    assert sorted(tuple(r) for r in second_pass.applied(records, found).collect()) == few
    assert sorted(tuple(r) for r in second_pass.preview(records, found).collect()) == seen
    assert sum(n for *_, n in few) > 100


def test_fifty_thousand_targets(spark):
    found = spark.range(50_000).select(F.concat(F.lit("name"), "id").alias("value"), F.lit("[PERSON]").alias("token"), (F.col("id") + 1).cast("int").alias("place"))
    records = spark.createDataFrame([("name7 met name49999, not name50000",), ("nobody",)], "text string")
    assert {(r["text"], r["substitutions"]) for r in second_pass.applied(records, found).collect()} == {("[PERSON] met [PERSON], not name50000", 2), ("nobody", 0)}


def test_a_hundred_thousand_targets_in_one_automaton(spark):
    found = spark.range(100_000).select(F.concat(F.lit("Case "), (F.col("id") % 997).cast("string"), F.lit(" of name"), "id").alias("value"), F.lit("[CASE_NO]").alias("token"), (F.col("id") + 1).cast("int").alias("place"))
    texts = [f"see CASE {i % 997} of name{i}, case {i % 997} of name{i}x, case of name{i}. " for i in range(0, 100_000, 5000)]
    records = spark.createDataFrame([(t * 20,) for t in texts], "text string")
    got = second_pass.applied(records, found).collect()
    assert len(got) == len(texts) and all(r["substitutions"] == 20 and r["text"].count("[CASE_NO]") == 20 for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab -[]é", min_size=1, max_size=6), min_size=1, max_size=12), st.text("ab -[]éA", max_size=30))
def test_the_automaton_finds_what_each_pattern_finds(phrases, text):
    want = set()
    for k, v in enumerate(phrases):
        left, right = (r"\b" if re.match(r"\w", c) else "" for c in (v[0], v[-1]))
        if re.search(left + re.escape(v) + right, text, re.IGNORECASE):
            want.add(k)
    assert want == Automaton(phrases).find(text)


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("k").alias("k")).repartition(7)
    got = ordinal(rows, "n", F.desc("x"), "k").collect()
    assert len(got) == 5000 and all(r["n"] == 4999 - r["x"] for r in got)
    assert ordinal(rows.limit(0), "n", "x").count() == 0
    assert spread(rows).count() == 5000


def test_slices_find_what_the_whole_finds(spark):
    text = ("word " * 7 + "jane@example.com or Mrs. Ada Byron, 12 Elm Street. ") * 9
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    whole = df.select(spans.found(F.col("text")).alias("s")).collect()
    cut = df.select(spans.segmented(F.col("text"), 86).alias("s")).collect()
    in_order = lambda rows: [sorted(r["s"]) for r in rows]
    assert in_order(whole) == in_order(cut) and len(whole[0]["s"]) == 27


def test_table_functions(spark):
    register.register(spark)
    got = spark.sql("select entity_type, found from detect_pii('SSN 123-45-6789, jane@example.com, DL D1234567')").collect()
    assert {tuple(r) for r in got} == {("US_SSN", "123-45-6789"), ("EMAIL_ADDRESS", "jane@example.com"), ("US_DRIVER_LICENSE", "D1234567")}
    assert spark.sql("select c.total from (select 'a b c' t) x, lateral chunk(x.t, 'private') c").first()[0] == 1
    assert spark.sql("select count_tokens('a, b')").first()[0] == 3


def test_words_are_equal_where_patterns_are(spark):
    row = spark.sql("select 'ẞ' a, 'ß' b, 'ſ' c, 's' d, 'İ' e, 'i' f, 'Σς' g, 'σσ' h").select(*[T.words(F.col(c))[0].alias(c) for c in "abcdefgh"]).first()
    assert row["a"] == row["b"] and row["c"] == row["d"] and row["e"] == row["f"] and row["g"] == row["h"]
