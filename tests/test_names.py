"""The tagger of names: its decoder by enumeration, its fit, what it finds on lines it was not fitted to, and edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import tagging as G
from quillmill.operators import names, process
from quillmill.plans.corpus import corpus

SF = "/root/testdata/sf0.001"


def value(path, scores, step):
    before, total = len(G.TAGS), 0
    for t, s in zip(path, scores):
        total += int(step[before, t]) + int(s[t])
        before = t
    return total


def test_viterbi_is_the_best_of_all_paths():
    rnd = np.random.default_rng(3)
    lengths = np.array([3, 1, 5, 2, 4, 1, 5])
    scores = rnd.integers(-9, 10, (lengths.sum(), len(G.TAGS)))
    step = G.steps() + rnd.integers(-9, 10, G.steps().shape)
    got = G.viterbi(scores, lengths, step)
    at = 0
    for n in lengths:
        mine = scores[at : at + n]
        best = max(value(p, mine, step) for p in itertools.product(range(len(G.TAGS)), repeat=int(n)))
        assert value(got[at : at + n].tolist(), mine, step) == best
        at += n


@pytest.fixture(scope="module")
def model(spark):
    return names.fitted(spark)


def test_short_sentences_of_the_corpus_by_enumeration(spark, model):
    texts = [r["raw"] for r in corpus(spark, SF).select("raw").collect()]
    short = [[t[a:b] for a, b in s] for t in texts for s in G.sentences(t) if len(s) <= 5][:400]
    lengths = np.array([len(s) for s in short])
    tags = model.tag([w for s in short for w in s], lengths)
    at = 0
    for words in short:
        scores = np.stack([model.rows[r].sum(axis=0) for r in G.sentence_rows(words)])
        best = max(value(p, scores, model.step) for p in itertools.product(range(len(G.TAGS)), repeat=len(words)))
        assert value(tags[at : at + len(words)].tolist(), scores, model.step) == best
        at += len(words)


def test_held_out_lines(spark, model):
    got = {r["kind"]: r for r in names.quality(names.labelled(spark, 2000, held_out=True), model).collect()}
    assert got["PERSON"]["precision"] > 0.9 and got["PERSON"]["recall"] > 0.8
    assert got["LOCATION"]["precision"] > 0.9 and got["LOCATION"]["recall"] > 0.65


def test_a_model_does_not_depend_on_how_lines_lie(spark):
    lines = names.labelled(spark, 300)
    one, two = (names.fit(rows, passes=2) for rows in (lines, lines.orderBy(F.desc("id")).repartition(3)))
    assert (one.rows == two.rows).all() and (one.step == two.step).all()
    nothing = names.fit(lines.where("id < 0"), passes=1)
    assert nothing.entities(["Jane Roe"]) in ([[]], [[("PERSON", 0, 8)]]) and not nothing.rows.any()


def found(model, text):
    return [(k, text[a:b]) for k, a, b in model.entities([text])[0]]


def test_names_without_a_title(model):
    assert found(model, "Zoltan Kiss and Priya Raman met in Toledo.") == [("PERSON", "Zoltan Kiss"), ("PERSON", "Priya Raman"), ("LOCATION", "Toledo")]
    assert found(model, "To: Jane Roe\nFrom: John Doe\n") == [("PERSON", "Jane Roe"), ("PERSON", "John Doe")]
    assert found(model, "The court held that the motion was late.") == []


def test_null_empty_long_and_repeated_texts(spark, model):
    long = "word " * 60_000 + "and Zoltan Kiss said so. " + "🙂 " * 1000
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, long), (5, "Dear Jane Roe,"), (5, "Dear Jane Roe,"), (None, "Dear Jane Roe,")]
    table = spark.createDataFrame(rows, "id long, t string")
    got = {}
    for r in table.select("id", names.tagger(spark, model)(F.col("t")).alias("s")).collect():
        got.setdefault(r["id"], []).append([(s["start"], s["end"], s["text"]) for s in r["s"]])
    assert got[1] == got[2] == got[3] == [[]] and got[5] == [[(5, 13, "Jane Roe")]] * 2 and got[None] == [[(5, 13, "Jane Roe")]]
    assert all(long[a:b] == t for a, b, t in got[4][0]) and "Zoltan Kiss" in [t for _, _, t in got[4][0]]
    rnd = random.Random(1)
    many = [" ".join(rnd.choice(["Jane", "Roe", "of", "Paris", ".", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(50)]
    assert model.entities(many) == [model.entities([t])[0] for t in many]


def test_tagged_spans_stand_beside_those_by_pattern(spark, model):
    rows = [("a.eml", ".eml", "Mrs. Ada Byron wrote to Jane Roe at jane@example.com.")]
    docs = process.cleaned(process.classified(spark.createDataFrame(rows, "filename string, ext string, raw string")))
    spans = process.detected(docs, names.tagger(spark, model)).first()["spans"]
    assert sorted(s["text"] for s in spans if s["entity_type"] == "PERSON") == ["Ada Byron", "Jane Roe"]
    out = process.redacted(process.detected(docs, names.tagger(spark, model))).first()["text"]
    assert "Roe" not in out and "Byron" not in out
