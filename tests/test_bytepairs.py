"""Byte-pair counts against plain merging, prefix sums against counting, and the splitter against one that counts every piece."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillmill.functions import bytepairs, chunks
from quillmill.plans import queries

SF = os.environ.get("QUILLMILL_SF", "/root/testdata/sf0.001")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd():
    pick = random.Random(5)
    letters = "ab \n\t'sré१你.,9 \n\nI. A."
    return ["", " ", "\n\n", "x" * 3000, "ab" * 700, *("".join(pick.choice(letters) for _ in range(pick.randrange(90))) for _ in range(400))]


def plain_merge(ranks, data):
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


def plain_split(text, size, overlap, separators, count):
    """Counts each piece, and adds and takes pieces one by one."""

    def join(pieces):
        out, now, total = [], deque(), 0
        for p in pieces:
            n = count(p)
            if now and total + n > size:
                out.append("".join(now).strip())
                while now and (total > overlap or total + n > size):
                    total -= count(now.popleft())
            now.append(p)
            total += n
        return [*out, "".join(now).strip()] if now else out

    use = next((s for s in separators if s in text), None)
    if use is None:
        return [text.strip()]
    later = separators[separators.index(use) + 1 :]
    if use:
        first, *rest = text.split(use)
        pieces = [p for p in (first, *(use + r for r in rest)) if p]
    else:
        pieces = list(text)
    out, small = [], []
    for p in pieces:
        if count(p) < size:
            small.append(p)
        else:
            out += join(small) + plain_split(p, size, overlap, later, count)
            small = []
    return out + join(small)


def test_heap_merges_as_rescanning_does(odd):
    pairs = bytepairs.byte_pairs(PATH)
    for text in odd:
        for piece in pairs.pattern.findall(text[:400]):
            want = plain_merge(pairs.ranks, piece.encode())
            assert pairs.merged(piece.encode()) == want
            assert pairs.weigh(piece) == len(want)
    assert "".join(b.decode("latin-1") for b in pairs.merged("x".encode() * 50_000)) == "x" * 50_000


@pytest.mark.parametrize("kind", ["words", "pairs"])
def test_sums_of_any_part(odd, kind):
    count = chunks.word_tokens if kind == "words" else bytepairs.byte_pairs(PATH)
    pick = random.Random(6)
    for text in odd:
        known = chunks.sums(text, count)
        for _ in range(12):
            a = pick.randrange(len(text) + 1)
            b = pick.randrange(a, len(text) + 1)
            assert known.between(a, b) == count(text[a:b]), (text, a, b)


@pytest.mark.parametrize("kind", ["words", "pairs", "characters"])
def test_splitter_by_one_that_counts_every_piece(odd, kind):
    count = {"words": chunks.word_tokens, "pairs": bytepairs.byte_pairs(PATH), "characters": len}[kind]
    for size, overlap in ((7, 2), (12, 5), (3, 0), (40, 39)):
        for separators in (chunks.COMMON_SEPARATORS, chunks.LEGAL_SEPARATORS, ["\n"]):
            splitter = chunks.Splitter(size, overlap, separators, count)
            for text in odd[:2] + odd[5:250]:
                want = [c for c in plain_split(text, size, overlap, separators, count) if c]
                assert splitter.split(text) == want, (text, size, overlap)
                assert [n for _, _, n in splitter.places(text)] == [count(c) for c in want]


def test_queries_by_brute_force(spark):
    pairs = bytepairs.byte_pairs(PATH)
    plain = {}

    def count(text):
        n = 0
        for piece in pairs.pattern.findall(text):
            if piece not in plain:
                data = piece.encode()
                plain[piece] = 1 if data in pairs.ranks else len(plain_merge(pairs.ranks, data))
            n += plain[piece]
        return n

    want = {r["doc_id"]: None if r["text"] is None else count(r["text"]) for r in queries.documents(spark, SF).select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["tokens"] for r in queries.byte_pair_counts(spark, SF).collect()} == want

    got = {(r["doc_id"], r["index"]): (r["total"], r["token_count"], r["text_sha256"]) for r in queries.byte_pair_chunks(spark, SF).collect()}
    rows = queries.process.cleaned(queries._classified(spark, SF)).select("doc_id", "doc_type", "clean").collect()
    parts = []
    for r in rows:
        size, overlap = chunks.CONFIG.get(r["doc_type"], chunks.CONFIG["private"])
        separators = chunks.LEGAL_SEPARATORS if r["doc_type"] == "caselaw" else chunks.COMMON_SEPARATORS
        texts = [c for c in plain_split(r["clean"], size, overlap, separators, count) if c] or [r["clean"]]
        parts += [(r["doc_id"], k, len(texts), count(t), t) for k, t in enumerate(texts)]
    hashed = spark.createDataFrame(parts, "doc_id long, index int, total int, n int, text string").withColumn("text", F.sha2("text", 256))
    assert got == {(r["doc_id"], r["index"]): (r["total"], r["n"], r["text"]) for r in hashed.collect()}


def test_null_empty_and_repeated_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",), ("a b",)], "text string")
    rows = df.select(bytepairs.token_count(F.col("text"), PATH).alias("n")).collect()
    assert sorted((r["n"] for r in rows), key=str) == [0, 2, 2, None]
    assert spark.createDataFrame([], "text string").select(bytepairs.token_count(F.col("text"), PATH)).count() == 0
