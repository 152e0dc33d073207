"""Rows of one id, clashing names and hostile pages."""

import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bagminhash, html_tree, packing, pii, quality, substrings

SF = "/root/testdata/sf0.001"
A, B, C, D = (" ".join(f"{w}{i}" for i in range(12)) for w in "abcd")


def page_text(source):
    return "".join(t for run in html_tree.Page(source).runs for _, t in run)


@pytest.mark.parametrize("piece", ['<a "', '<a ">"', "<a ", '<a ">', "<svg>", "<noscript>", "<!x", '<a "\'', "</svg ", "<a href='x\">"])
def test_hostile_pages_take_no_longer_than_their_length(piece):
    source = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    html_tree.Page(source[:100_000])
    small = time.perf_counter() - began
    began = time.perf_counter()
    html_tree.Page(source)
    assert time.perf_counter() - began < max(30 * small, 5)


def test_quotes_that_do_not_close():
    assert page_text('<p title="x>one</p> two') == "one two"
    assert page_text('<p title="a > b">one</p>') == "one"
    assert page_text('x<p>y</p>z <!-- never closed > <p>w') == "xyz "
    assert page_text("a < b <c") == "a < b <c" and page_text("a <!doctype") == "a " and page_text("<p>x</p> y <? z") == "x y "


@pytest.mark.parametrize("rows", [[(1, A), (1, B), (2, C), (2, A)], [(1, A), (1, B), (1, C), (2, A), (2, B), (3, D), (3, A), (1, A)], [(5, D), (4, D), (4, A), (4, B), (5, B)]])
def test_several_texts_of_one_id(spark, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = bagminhash.near_duplicates(docs).collect()
    text = {r["h"]: r["text"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    least = {t: min(i for i, u in rows if u == t) for _, t in rows}
    assert Counter((r["id"], text[r["h"]], r["class_id"], text[r["class_h"]]) for r in got) == Counter((i, t, least[t], t) for i, t in rows)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((i, t) for t, i in least.items())


@pytest.mark.parametrize("name", [*quality.OWN, "__HOST", "q_keep"])
def test_quality_keeps_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "some text here", "en", "s", 7), (2, None, None, None, 8)], f"doc_id long, text string, lang string, source string, {name} int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.quality(docs, labels)
    want = [c for c in docs.columns if not c.startswith("q_")] + ["q_evidence", "q_path", "q_posterior", "q_keep"]
    assert sorted(got.columns) == sorted(want)
    rows = {r["doc_id"]: r for r in got.collect()}
    if name != "q_keep":
        assert rows[1][name] == 7 and rows[2][name] == 8


@pytest.mark.parametrize("text, rows", [("the same few words of a notice again", 100_000), (None, 200_000)])
def test_equal_rows_of_one_id_are_packed_in_many_groups(spark, text, rows):
    ranks = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    df = spark.range(0, rows, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).cast("string").alias("text"))
    got = packing.pack(df, ranks, group_bytes=100_000).select("start", "length", "doc_tokens", (F.col("sequence_id") / (1 << 24)).cast("long").alias("grp"))
    groups = got.where("start = 0").groupBy("grp").count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    size = (len(text or "") + packing.ROW_BYTES) * rows
    assert groups[0] == rows and groups[2] == -(-size // 100_000) and groups[1] < 1.5 * rows / groups[2]
    assert got.agg(F.sum("length")).first()[0] == got.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_given_names_take_a_keyed_order(spark):
    steps = set()
    for key in ("one", "two", "three"):
        new = pii.next_given(key)
        for names in pii.GIVEN.values():
            assert {new[n] for n in names} == set(names) and all(new[n] != n for n in names)
        names = pii.GIVEN["Latin", "m"]
        steps.add(tuple((names.index(new[n]) - names.index(n)) % len(names) for n in names))
    assert len(steps) == 3 and min(len(set(s)) for s in steps) > 10  # no one step moves all
    people = spark.createDataFrame([(n, f"Mr. {n} Oakenshield") for n in pii.GIVEN["Latin", "m"]], "name string, text string")
    got = {r["name"]: r["text"].split() for r in pii.replace_pii(people, "one").collect()}
    new = pii.next_given("one")
    assert all(words[1] == new[n] for n, words in got.items()) and len({words[2] for words in got.values()}) == 1


def test_persons_share_a_surname_when_it_is_drawn_anew(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "Latin", ["ba", "ka"] * 16)  # 32 first draws
    surnames = [f"Ab{a}{b}ott" for a in "abcdefgh" for b in "klmno"]
    rows = [(w, f"Mr. {w} met Mr. John {w}; MR. left and Mrs. Anna {w} stayed.") for w in surnames]
    got = {r["w"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(rows, "w string, text string"), "key").collect()}
    new = {}
    for w, text in got.items():
        lone, full, wife = text.removeprefix("Mr. ").split(" ")[0], text.split(" met Mr. ")[1].split(";")[0], text.split("Mrs. ")[1].removesuffix(" stayed.")
        assert full.split()[-1] == wife.split()[-1] == lone and len(full.split()) == len(wife.split()) == 2 and full != wife
        new[w] = lone
    assert len(set(new.values())) == len(surnames) and not set(new.values()) & set(surnames)


def test_words_of_one_text_at_a_time_are_held():
    import tracemalloc

    import public_tokenizers

    from quillmill.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokens.WordTokenizer(path)
    odd = ["a-b 12 (x) ... é ÉTÉ, été. K 漢字 don't\nx\ty  z", "", None, "ß ſ İ Éá!? x#", "…"]
    assert list(tok.encode(odd)) == [tok.pack(tok.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in odd]
    texts = ["The river ran along the old mill, while nobody spoke of it. " * 80] * 400
    list(tok.encode(texts[:1]))
    tracemalloc.start()
    got = list(tok.encode(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(got)) == 1 and peak < 15_000_000
    tokens.tokenizer(path)
    tokens.forget(path), tokens.forget(path)
    assert path not in tokens._LOADED


def test_blocks_count_lists_as_well_as_texts():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("digest", pa.binary())]))
    claims = pa.array([[{"start": i, "length": 20, "digest": b"d" * 16} for i in range(5_000)]] * 6 + [None, []], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(["x", None] * 4), claims], ["text", "claims"])
    parts = list(substrings.blocks([batch], "text", "claims"))
    assert max(sum(len(c or []) for c in asked) for _, asked in parts) == 5_000
    assert [t for texts, _ in parts for t in texts] == ["x", None] * 4 and [c for _, asked in parts for c in asked] == claims.to_pylist()
    texts = [None, "a" * 400, "b" * 400, "c" * 5_000, ""]
    assert [part for (part,) in substrings.blocks([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], "text", at_once=1_000)] == [texts[:3], texts[3:4], texts[4:]]
