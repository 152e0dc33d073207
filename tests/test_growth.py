"""What grows with the input: rows computed once, time in proportion to lines, tagging in bounded slices."""

import time

from pyspark.sql import functions as F

from quillmill.functions import classify, spans, text
from quillmill.functions import tagging as G
from quillmill.llm import shared
from quillmill.operators import names, process
from quillmill.plans.corpus import corpus
from quillmill.sources.shared import dealt, ordinal

SF = "/root/testdata/sf0.001"


def test_rows_to_be_numbered_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = ordinal(spark.range(0, 2000, 1, 5).mapInArrow(counted, "id long"), "n", F.desc("id")).collect()
    assert all(r["n"] == 1999 - r["id"] for r in got) and len(got) == 2000
    assert seen.value == 2000


def test_repeated_lines_take_time_in_proportion(spark):
    lines = [f"line {i}  " for i in range(12_000)] + [" often", "often ", "\toften"] * 3 + ["", "a" + " " * 20_000 + "b"]
    row = spark.createDataFrame([("\n".join(lines),), (None,)], "t string")
    began = time.time()
    got = [r["v"] for r in row.select(text.drop_repeated_lines(F.col("t")).alias("v")).collect()]
    assert time.time() - began < 40
    assert got == ["\n".join([f"line {i}" for i in range(12_000)] + lines[-2:]), None]


def test_guards_let_every_match_through(spark):
    rows = ["a@b.org", "May 5, 2020", "Jan. 3 2020", "2020-01-02", "on 1/2/2020", "01-02-2020", "5 May\n2020", "May 2020", "Sept 2020 Dec. 2021", "x\u0001 May 5 2020", "12345", ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    want = [F.col("t").rlike(spans.marked(k)[1]) for k in spans.HOLDS]
    got = df.select(F.transform(spans.found(F.col("t"), tuple(spans.HOLDS)), lambda e: e["entity_type"]).alias("k"), F.array(*want).alias("w")).collect()
    assert [[k in r["k"] for k in spans.HOLDS] for r in got] == [r["w"] for r in got] and sum(map(sum, (r["w"] for r in got))) == 10


def test_reviewed_patterns_are_guarded_too(spark):
    assert set(spans.REVIEWED) <= set(spans.HOLDS)
    rows = ["4111 1111-1111 1", "(312) 555-0100", "+44 (312)555-0100", "acct no. 12345678", "ROUTING: #00123456789", "Passport number: A12345678", "passport 123456789", "driver's license D123", "DL X12345678901234", "DEA AB1234567", "medical license no.: ab1234567", "1234", ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    want = [F.col("t").rlike(spans.marked(k)[1]) for k in spans.REVIEWED]
    got = df.select(F.transform(spans.found(F.col("t"), spans.REVIEWED), lambda e: e["entity_type"]).alias("k"), F.array(*want).alias("w")).collect()
    assert [[k in r["k"] for k in spans.REVIEWED] for r in got] == [r["w"] for r in got] and sum(any(r["w"]) for r in got) == 11


def _plain_scores(col):
    return F.struct(*[sum((F.when(classify.fires(col, p), w).otherwise(0.0) for p, w in ps), F.lit(0.0)).alias(k) for k, ps in classify.SIGNALS.items()])


def test_guarded_signals_fire_as_before(spark):
    rows = [
        "123 F.3d 456", "٣ f.٣d\u00a0٤", "1\u20285 a.2 7", "1 u.s. 2", "9 S.Ct. 1", "9 N.E.2 1", "9 P.4 1", "8 Cal. 3", "8 N.Y. 3", "8 ill. 3", "8 TEX. 3", "opinion", "OPİNİON", "opınıon", "REVERſED", "per curıam", "judgment",
        "WL 5", "wl 5", "WESTLAW", "lexiſnexis", "© 2020 Thomson Reuters", "Volume 3, Issue 4", "VOL. 3 no. 4", "ıSSN: 12", "İSBN 12", "cle", "uncle", "Law Revİew", "bar journal", "© 2020 Abc", "to: x", "\nFrom: y", "ſubject: z", "bcc: q",
        "Attorneys for", "PLAıNTİFF", "in the matter of", "law division", "Dear Bob", "Sincerely,", "\u212aind regards,", "case note", "client file", "CONFİDENTIAL", "İ", "ß ſſ", "", None, "x" * 5000 + " opinion",
    ]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", classify.raw_scores(F.col("t")).alias("a"), _plain_scores(F.col("t")).alias("b")).collect()
    assert [r["t"] for r in got if r["a"] != r["b"]] == []
    assert sum(sum(r["a"]) > 0 for r in got) == 44


def test_signals_that_cannot_fire_cost_little(spark):
    prose = spark.range(0, 4000, 1, 4).select(F.concat(F.repeat(F.lit("The river ran along the old mill while nobody spoke of it. "), 80), F.col("id").cast("string")).alias("t")).cache()
    prose.count()

    def took(scores):
        began = time.time()
        prose.select(F.sum(F.hash(scores).cast("long"))).collect()
        return time.time() - began

    assert min(took(classify.raw_scores(F.col("t"))) for _ in range(3)) < 0.6 * min(took(_plain_scores(F.col("t"))) for _ in range(2))


def test_flags_without_the_rest_are_the_same(spark):
    assert spans.REVIEWED == ("CREDIT_CARD", "PHONE_NUMBER", "US_BANK_NUMBER", "US_PASSPORT", "US_DRIVER_LICENSE", "MEDICAL_LICENSE")
    docs = process.classified(corpus(spark, SF)).withColumn("excluded", F.array(F.lit("(312) 555-0100")))
    for excluded in (None, "excluded"):
        lean = process.review_log(process.reviewed(docs, excluded))
        whole = process.review_log(process.redacted(process.detected(process.cleaned(docs)), excluded))
        assert sorted(lean.collect()) == sorted(whole.collect()) != []


FLAGGED = [
    "4111 1111-1111 1", "4111  1111\t 1111 \t 11", "4111–1111–1111–1111", "4111\u00011111\u00011111 1", "4111111111111111", "x 4111 1111 1111 1111\u00a0", "(312) 555-0100", "+44 (312)555-0100", "acct no.  12345678",
    "ROUTING:\t\t#00123456789", "Passport number: A12345678", "passport 123456789", "driver’s  license D123", "DL X12345678901234", "DEA AB1234567", "medical license no.: ab1234567", "12 \n 7 DL\t\tD123",
]
UNFLAGGED = ["", None, "plain words", "2024-03-15", "SSN 123-45-6789", "ISSN: 0019-1876", "4111\n1111\n1111\n1", "312 555-0100", "10.0.0.7", "4111—1111—1111—1", "DL d123", "1234567"]


def test_texts_that_cannot_be_flagged_go_first(spark):
    docs = spark.createDataFrame([("f", "uncertain", t) for t in FLAGGED + UNFLAGGED], "filename string, doc_type string, raw string")
    lean = {r["raw"]: r["review_flags"] for r in process.reviewed(docs).collect()}
    whole = {r["raw"]: r["review_flags"] for r in process.redacted(process.detected(process.cleaned(docs))).collect()}
    assert {t for t in whole if whole[t]} <= set(lean) <= set(FLAGGED)
    assert all(lean[t] == whole[t] for t in lean) and sum(bool(f) for f in whole.values()) >= 14
    plan = process.reviewed(process.classified(docs.withColumn("ext", F.lit(".txt"))))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.rindex("Generate inline") < plan.rindex("Filter")  # tested before texts are classified


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    text = F.concat_ws("", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f" {k}")), 256) for k in range(100)])
    spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.select(F.spark_partition_id()).distinct().count() == 1
    got = dealt(one)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and max(t["count"] for t in tasks) < 1000
    assert got.exceptAll(one).isEmpty() and got.count() == 4000
    plan = dealt(one).where(F.col("text").rlike("abc"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Repartition")  # the condition is not tested in the one task
    one.repartition(4).write.parquet(f"{tmp_path}/four")
    four = spark.read.parquet(f"{tmp_path}/four")
    assert dealt(four) is four


def test_texts_are_tagged_in_bounded_slices(spark, monkeypatch):
    model = names.fitted(spark)
    texts = ["Dear Jane Roe, the court met in Paris. " * 40, None, ""] * 100
    want = [model.entities([t])[0] for t in texts[:3]]
    seen, tag = [], model.tag
    monkeypatch.setattr(model, "tag", lambda words, lengths: seen.append(len(words)) or tag(words, lengths))
    monkeypatch.setattr(G.Model, "AT_ONCE", 500, raising=False)
    assert model.entities(texts) == want * 100
    assert max(seen) <= 500 and sum(seen) == 100 * 40 * 10
    assert len(model.known) <= len(model.table) == len(model.shapes)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    got = [[(s["entity_type"], s["start"], s["end"]) for s in r["s"]] for r in rows.select(names.tagger(spark, model)(F.col("t")).alias("s")).collect()]
    assert sorted(map(len, got)) == sorted(map(len, want * 100))


def test_a_grown_heap_is_given_back_between_tables(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(shared, "release", lambda s: asked.append(s))
    monkeypatch.setattr(shared, "TAKEN", 0.0)
    assert shared.materialize(spark.range(3), "few").count() == 3 and asked == [spark]
    monkeypatch.setattr(shared, "TAKEN", 1.0)
    assert shared.materialize(spark.range(3), "few").count() == 3 and asked == [spark]
