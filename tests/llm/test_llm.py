"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bagminhash, components, html_model, mtree, packing, pii, quality, queries, records, sentencepieces, substrings, vptree
from quillmill.llm.tokens import WordTokenizer

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BYTES, WORDS, MODEL = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
#: Nulls, empty and repeated rows, ties, a long text and columns with clashing names.
ODD = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "a b c", "y"), (1, "a b c", "x"), (4, "word " * 20000, "x"), (5, "Ünïcode é x  double\n\n漢字 🙂", "y")]
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"id": F.lit(7), "n": F.lit("n"), "label": F.lit(1), "start": F.lit("s")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = ["", " ", "  a b", "a  b \n c", "\n\nx y", "don't stop's I'LL", "x y　z", "a\tb c\n", "Ünïcode é ａｂｃ 漢字 12345 3.14", "<|endoftext|> a", "A\r\nB  C", "x\x1cy z", "İstanbul ǅ Σας ﬁ é"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_token_ids_are_the_librarys(spark, path):
    t = WordTokenizer(path, cache_size=50)
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, got in zip(texts, t.encode(texts, at_once=5000)):
        assert np.frombuffer(got, t.dtype).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_sentencepiece_query_by_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_sentencepiece(spark, SF).collect():
        ids = lib.encode(docs[r["doc_id"]])
        decoded = lib.decode(ids)
        want = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(decoded), zlib.crc32(decoded.encode()))
        assert (r["n_tokens"], r["ids_crc32"], r["n_chars"], r["decoded_crc32"]) == want


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_inside_a_text_have_their_ids(path):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(path)
    t = WordTokenizer(path)
    texts = ["see <|endoftext|> here", "plain", "<|startoftext|>a<|endoftext|>b", "<|ENDOFTEXT|> x", "<|endof\ntext|>", "漢字 <|endoftext|>", ""]
    assert [np.frombuffer(x, t.dtype).tolist() for x in t.encode(texts)] == [fresh.encode(x, add_special_tokens=False).ids for x in texts]


# ---- packing


def test_first_fit_decreasing_is_first_fit():
    rnd = random.Random(5)
    for _ in range(50):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 60))]
        bins: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            place = next((b for b in bins if sum(sizes[k] for k in b) + sizes[i] <= 20), None)
            if place is None:
                bins.append(place := [])
            place.append(i)
        assert packing.first_fit_decreasing(sizes, 20) == bins


def test_packed_pieces_cover_every_document_once(spark, odd):
    got = packing.pack(odd, BYTES, group_bytes=20_000).collect()
    t = WordTokenizer(BYTES)
    want = collections.Counter()
    for doc, text, _ in ODD:
        want[doc, len(t.tokenizer.encode(text or "", add_special_tokens=False).ids) + 1] += 1
    per = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        per[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    for (doc, n), copies in want.items():
        assert sum(x for _, x in per[doc, n]) == n * copies
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0


def test_packing_query_by_brute_force(spark):
    t = WordTokenizer(BYTES)
    docs = {r["doc_id"]: t.tokenizer.encode(r["text"], add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = collections.Counter()
    for r in queries.op1_packing(spark, SF).collect():
        ids = docs[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(i) for d, i in docs.items()}


# ---- SentencePiece


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.Pieces(MODEL, cache_size=100)
    texts = TEXTS + ["▁x ▁▁ y", "a\0b", "😀😀 ñ", "a    b        c", "ab" * 50, "x" * 300, "日" * 70] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for text, got in zip(texts, own.encode(texts)):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == lib.encode(text), text[:80]
        assert own.decode(ids) == lib.decode(ids)


def test_unigram_relaxation_is_the_best_path():
    rnd = random.Random(2)
    vocab = {"▁": -3.0, **{c: -4.0 - k / 7 for k, c in enumerate("abc")}}
    for _ in range(12):
        vocab["".join(rnd.choice("abc▁"[: 3 + (k == 0)]) for k in range(rnd.randint(2, 4)))] = -rnd.uniform(3, 9)
    vocab = {k: v for k, v in vocab.items() if "▁" not in k[1:]}
    own = sentencepieces.Pieces.of(vocab, bpe=False)
    ids = {p: i for i, p in enumerate(vocab, 1)}

    def best(word):
        if not word:
            return 0.0
        return max([vocab[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in vocab], default=-1e9)

    for _ in range(60):
        word = "▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        got = np.frombuffer(own.match([word])[0], "<u4").tolist()
        pieces = {v: k for k, v in ids.items()}
        assert "".join(pieces[i] for i in got) == word and abs(sum(vocab[pieces[i]] for i in got) - best(word)) < 1e-9


def test_sentencepiece_frames(spark, odd, empty):
    rows = sentencepieces.decode(sentencepieces.encode(odd, MODEL), MODEL).collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["decoded"] for r in rows}[5] == ODD[-1][1]
    assert all(r["ids"] == b"" for r in rows if not r["text"])
    assert sentencepieces.encode(empty, MODEL).count() == 0


# ---- metric indexes


def vectors(n=400, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, 8)), 2)
    v[50:120] = v[7]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [0.0] * 8), (904, []), (905, [1.0, 2.0])]
    # repeated rows, and rows of one id with different vectors
    return rows + rows[:4] * 6 + [(i, [-x for x in rows[i][1]]) for i in (0, 1, 9, 9, 18)]


def brute(rows, asked, k, whole):
    use = [(i, np.floor(256 * np.array(v)) if whole else np.array(v)) for i, v in rows]
    out = collections.Counter()
    for q, x in {(q, tuple(x)) for q, x in use if asked(q)}:
        x = np.array(x)
        scores = sorted((-float(np.cumsum(x * y)[-1]), i) for i, y in use if i != q and len(y) == len(x))
        out.update((q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1))
    return out


@pytest.mark.parametrize("shard_rows", [60, 8192])
def test_top_k_is_exact(spark, monkeypatch, shard_rows):
    from quillmill.llm import metric

    monkeypatch.setattr(metric.search, "__defaults__", (1.0, shard_rows))
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit(1), "dim": F.lit(2), "cluster": F.lit(3), "copies": F.lit(0)})
    good = [(i, np.float32(v).astype(float)) for i, v in rows if i < 900 or i in (903, 905)]
    for found, whole, k in ((mtree.top_k(df, df.where("vec_id % 9 = 0")), True, 5), (vptree.neighbours(df, df.where("vec_id % 9 = 0"), factor=1.0), False, 20)):
        got = collections.Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())
        use = good if whole else [x for x in good if np.any(x[1])]
        assert got == brute(use, lambda i: i % 9 == 0, k, whole)


def test_copies_are_so_many_answers(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [5.0, 0.0])] * 6 + [(i, [0.5, i / 100]) for i in range(10, 51)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for found in (mtree.top_k(df, df.where("vec_id = 0"), k=5), vptree.neighbours(df, df.where("vec_id = 0"), k=5)):
        assert [r["id"] for r in found.orderBy("rank").collect()] == [7] * 5


def clustered(n=6000, dims=64, groups=60, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1)[:, None]


def share_and_recall(v, factor, module=vptree, k=20):
    """The share of distances that a tree computes for 100 of its own rows, and the recall against brute force."""
    ids, stats, hits = np.arange(len(v)), {}, 0
    tree = module.build(ids, v)
    options = {"factor": factor} if module is vptree else {}
    for q in range(0, len(v), len(v) // 100):
        scores = v @ v[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:k].tolist()) & {i for i, _ in module.find(tree, q, v[q], k, stats=stats, **options)})
    asked = len(range(0, len(v), len(v) // 100))
    return stats["computed"] / (asked * len(v)), hits / (asked * k)


def test_trees_leave_out_most_of_clustered_data():
    v = clustered()
    assert share_and_recall(v, 1.0)[1] == 1.0
    share, recall = share_and_recall(v, vptree.FACTOR)
    assert share < 0.6 and recall >= 0.9
    share, recall = share_and_recall(v, None, mtree)
    assert share < 0.6 and recall == 1.0


def test_clusters_that_lie_too_far_are_not_asked(spark, monkeypatch, tmp_path):
    from quillmill.llm import metric

    monkeypatch.setattr(metric.search, "__defaults__", (1.0, 60))
    v = clustered(3000, groups=12)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = spark.sparkContext.accumulator(0)

    def counting(tree, q, x, k, floor):
        asked.add(len(tree["ids"]))
        return vptree.find(tree, q, x, k, floor, 1.0)

    rows = metric.search(metric.valid(df, "vec_id", "embedding"), metric.valid(df.where("vec_id % 50 = 0"), "vec_id", "embedding"), 5, vptree.build, counting).collect()
    assert asked.value < 0.7 * 60 * 3000
    want = brute([(i, x) for i, x in enumerate(v)], lambda i: i % 50 == 0, 5, False)
    assert collections.Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in rows) == want


def test_approximate_neighbours_reach_the_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = total = 0
    for r in queries.op10_neighbours(spark, SF).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect():
        q = int(np.flatnonzero(ids == r["query_id"])[0])
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]].tolist()) & set(r["found"]))
        total += 20
    assert hits / total >= 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.top_k(none, none).count() == 0 and vptree.neighbours(none, none).count() == 0


# ---- HTML


def test_main_text_of_unseen_pages():
    rnd, model = random.Random(4242), html_model.default_model()
    same = 0
    for _ in range(100):
        page, main = html_model.labelled_page(rnd)
        same += html_model.main_texts([page], model)[0] == " ".join(" ".join(m.split()) for m in main)
    assert same >= 95


def test_layouts_held_out_of_the_labels():
    from difflib import SequenceMatcher

    from quillmill.llm.labelled_pages import PAGES

    def agreement(want, got):
        a, b = want.split(), got.split()
        return 2 * sum(m.size for m in SequenceMatcher(None, a, b, False).get_matching_blocks()) / (len(a) + len(b))

    scores = {}
    for name in sorted(PAGES):
        page, labels = html_model.labelled_tree(PAGES[name])
        model = html_model.default_model(without=name)
        scores[name] = agreement(page.text(labels), html_model.main_texts([PAGES[name]], model)[0])
    assert min(scores.values()) > 0.8 and sum(scores.values()) / len(scores) > 0.95, scores


def test_marginals_by_enumeration():
    from itertools import product

    page = html_model.Page("<body><article><p>a</p><div><p>b</p></div></article><nav>c</nav></body>")
    f, rng = html_model.Forest([page]), np.random.default_rng(0)
    w, pair = rng.normal(size=html_model.SIZE), rng.normal(size=(html_model.SORTS, 2, 2))
    unary, n = f.x @ w, len(f.parent)
    total, ones = 0.0, np.zeros(n)
    for state in product((0, 1), repeat=n):
        e = sum(u for u, s in zip(unary, state) if s) + sum(pair[f.sort[c], state[f.parent[c]], state[c]] for c in range(n) if f.parent[c] >= 0)
        total += np.exp(e)
        ones += np.exp(e) * np.array(state)
    assert np.allclose(html_model.marginals(f, w, pair), ones / total)


def test_html_edge_cases(spark):
    pages = [
        None, "", "<", "<article><p>a&amp;b&nbsp; c<br>d<p>e<b>f</b>g<script>x<y</script></article><nav>n</nav>", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000,
        "<article><!-- x --><p title='>'>q</p><aside>no</aside><section class=comments><p>me too</p></section></article>",
    ]
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(pages)], "page_id int, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_model.extract(df).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "a&b c d efg", 4: "deep", 5: "q"}
    slashes = "<article><script src='x'/>var a=1;</script><p>one<br/>two</p><div class=x/><p>three</p></div><svg/><p>four</p></article><div class='sidebar'/><p>no</p></div>"
    assert html_model.main_texts([slashes], html_model.default_model()) == ["one two three four"]
    assert html_model.extract(df.limit(0)).count() == 0
    long = "<article>" + "<p>some words of the text here</p>" * 60_000 + "</article><footer>no</footer>"
    twice = spark.createDataFrame([(1, long), (1, long)], "page_id int, html string")
    assert [r["text"] for r in html_model.extract(twice).collect()] == [" ".join(["some words of the text here"] * 60_000)] * 2


# ---- personal data


def test_surrogates(spark):
    text = 'Mail A.b@x.com, a.b@x.com; +1 (017) 555-7713, 4952935900253052, 4111 1111 1111 1111, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", 227.5.221.1. Mr. John Smith and Mary Smith, г-жа Анна Петрова, SSN 123-45-6789.'
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (1, text, "k"), (4, "Nothing to see, Ms. or otherwise.", "k")], "doc_id long, text string, n_entities string")
    rows = pii.replace_pii(df, "key").collect()
    first, *_ = [r for r in rows if r["doc_id"] == 1]
    out = first["text"]
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [out, out] and first["n_entities"] == 11
    for gone in ("x.com", "555-7713", "4952935900253052", "04dbeb", "227.5", "John", "Mary", "Smith", "Анна", "Петрова", "123-45"):
        assert gone not in out
    m = re.fullmatch(r'Mail (\S+), (\S+); (\+1 \(\d{3}\) \d{3}-\d{4}), (\d{16}), (\d{4} \d{4} \d{4} \d{4}), token = "([0-9a-f]{40})", (\d+\.\d+\.\d+\.\d+)\. Mr\. (\S+) (\S+) and (\S+) (\S+), г-жа (\S+) (\S+), SSN (\d{3}-\d{2}-\d{4})\.', out)
    assert m and m[1] == m[2] and m[9] == m[11]
    assert m[8] in pii.GIVEN["Latin", "m"] and m[10] in pii.GIVEN["Latin", "f"] and m[12] in pii.GIVEN["Cyrillic", "f"] and re.fullmatch("[А-я]+", m[13])
    digits = [int(c) for c in m[5] if c.isdigit()]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0  # a valid card stays valid
    rest = {r["doc_id"]: (r["text"], r["n_entities"]) for r in rows if r["doc_id"] != 1}
    assert rest == {2: (None, 0), 3: ("", 0), 4: ("Nothing to see, Ms. or otherwise.", 0)}
    assert pii.replace_pii(df, "other").where("doc_id = 1").first()["text"] != out


def test_different_numbers_stay_different(spark):
    texts = [f"({100 + i % 900}) {200 + i % 700}-{1000 + i}" for i in range(3000)] + [f"10.{i // 250}.{i % 250}.7" for i in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert pii.replace_pii(df, "key").select("text").distinct().count() == len(set(texts))


def test_collisions_lengthen_surrogates(spark):
    df = spark.createDataFrame([(i, f"Mr. Zz{a}{b}") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" * 3)], "doc_id long, text string")
    assert pii.replace_pii(df, "key").select("text").distinct().count() == df.select("text").distinct().count()


def replaced(spark, texts, key="key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.replace_pii(df, key).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])], [r["n_entities"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_entities_that_never_got_free(spark):
    texts = ["password: ********", "password: ########", "password: пароль-секрет", "password: ключключ", "Mr. Mcdonald", "Mr. McDonald"]
    people = ["Martin", "Thomas", "Henry", "Mark", "Daniel", "John"]
    texts += [f"Mr. {n}" for n in people] + ["Mr. Martin Weber", "Mr. Weber", "Mr. WEBER"]
    out, n = replaced(spark, texts, queries.PII_KEY)
    assert n == [1] * len(texts) and len(set(out)) == len(out) and not set(out) & set(texts)
    made = dict(zip(texts, out))
    assert made["Mr. Martin Weber"].endswith(made["Mr. Weber"][3:]) and made["Mr. WEBER"] == "Mr. " + made["Mr. Weber"][4:].upper()
    assert all(len(made[t]) == len(t) for t in texts[:4])


def test_crowded_secrets_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(pii, "SECRET_SYMBOLS", "-_")
    texts = ["password: " + f"{k:08b}".replace("0", "-").replace("1", "_") for k in range(60)]
    out, _ = replaced(spark, texts)
    assert len(set(out)) == len(out) and not set(out) & set(texts)


def test_long_secrets_go_whole(spark):
    jwt = "eyJ" + ".".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(15))
    secrets = [jwt, "sk-" + "Ab1" * 30, "ghp_" + "Zz9" * 20, "Ab.1" * 50_000]
    out, n = replaced(spark, [f"token={jwt} end", f"see {secrets[1]} end", f"see {secrets[2]} end", f"token={secrets[3]} end"])
    assert n == [1] * 4
    for text, secret in zip(out, secrets):
        assert text.endswith(" end") and not any(secret[k : k + 24] in text for k in range(0, len(secret), 24))


def test_the_guard_loses_nothing(spark):
    keys = ["AKIA" + "ABCDEFGHIJKLMNOP", "gho_" + "abcdefghi" * 4, "sk-" + "abcdefghij" * 2, "abcdef" * 6 + "abcd"]
    texts = [f"see {k} there" for k in keys] + ["token:  abcdefgh1234", "secret  =  abcdefghijkl", "token: abcdefgh1234", "g-n Mr. Nobody", "2001:db8::1", "Peter Nobody"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    bare = df.selectExpr(f"regexp_extract_all(text, {pii._q(pii.ENTITY)}, 0) as e").collect()
    guarded = df.select(pii.found().alias("x")).collect()
    assert [[x["entity"] for x in r["x"][1:]] for r in guarded] == [r["e"] for r in bare]
    assert [r["e"] for r in bare][:7] == [[k] for k in keys] + [["abcdefgh1234"], ["abcdefghijkl"], ["abcdefgh1234"]]


def test_usual_forms_are_found(spark):
    secret = "Hunter2-abcdef"
    texts = [s + secret for s in ("Password: ", "API_KEY=", "access_token=", "client_secret: ", "DB_PASSWORD=", "clientSecret = ", "SECRET_KEY=")]
    texts += ['{"password": "' + secret + '"}', "{'Token' : '" + secret + "'}"]
    addresses = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "2001:db8::", "1:2:3:4:5:6:7::", "2001:0DB8::1:0:0:1", "dead::beef"]
    cards = ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904"]
    texts += [f"at {a}, so" for a in addresses] + [f"card {c}." for c in cards]
    out, n = replaced(spark, texts)
    assert n == [1] * len(texts) and not any(secret in x for x in out)
    assert out[7].startswith('{"password": "') and out[7].endswith('"}')
    for x, text in zip(out[9:], addresses + cards):
        assert text not in x
    assert all(re.fullmatch(r"at (?:[0-9a-f]{4}:){7}[0-9a-f]{4}, so", x) for x in out[9:16])
    assert [re.sub(r"\d", "0", x) for x in out[16:]] == [re.sub(r"\d", "0", f"card {c}.") for c in cards]
    same, n = replaced(spark, ["at 2001:db8::1", "at 2001:DB8:0:0:0:0:0:1", "std::vector a::xyz", "secretary: somebody here", "at 10:30 :: so", "at 2001:db8::1: so"])
    assert same[0] == same[1] and n == [1, 1, 0, 0, 0, 1]


def test_a_person_reads_the_same_whatever_the_title(spark):
    people = [("Quinlan Abbott", "Latin"), ("Zoltan Kiss", "Latin"), ("Мирон Орлов", "Cyrillic"), ("Ζήνων Λάμπρου", "Greek")]
    titles = {"Latin": ["Mr.", "Mr.", "Mrs.", "Dr."], "Cyrillic": ["г-н", "г-н", "г-жа", "Dr."], "Greek": ["κ.", "κ.", "κα.", "Prof."]}
    texts = [f"{t} {name}" for name, script in people for t in titles[script]]
    texts += [f"Dr. {name} came. Later {name} left, and {name}son stayed." for name, _ in people] + [f"Mr. {name.split()[1]}" for name, _ in people]
    out, n = replaced(spark, texts)
    for k, (name, script) in enumerate(people):
        four = [x[len(t) + 1 :] for x, t in zip(out[4 * k : 4 * k + 4], titles[script])]
        assert len(set(four)) == 1 and four[0] != name
        assert out[16 + k] == f"Dr. {four[0]} came. Later {four[0]} left, and {name}son stayed." and n[16 + k] == 2
        assert out[20 + k] == f"Mr. {four[0].split()[1]}"
        if script == "Latin":
            assert four[0].split()[0].endswith("o")  # most titles are a man's
    assert len({x[4:] for x in out[::4][:4]}) == 4


def test_emitted_surrogates_are_all_different(spark):
    rnd = random.Random(11)
    name = lambda: rnd.choice("ABCDEFGH") + "".join(rnd.choice("aeioubdg") for _ in range(2))
    texts = [f"{rnd.choice(['Mr.', 'Ms.', 'Dr.', 'Frau'])} {' '.join(name() for _ in range(rnd.randint(1, 3)))}" for _ in range(800)]
    out, _ = replaced(spark, texts)
    bare = lambda t: t.split(" ", 1)[1]
    made = collections.defaultdict(set)
    for t, o in zip(texts, out):
        made[bare(t)].add(bare(o))
    assert all(len(x) == 1 for x in made.values())
    assert len({min(x) for x in made.values()}) == len(made) and not {min(x) for x in made.values()} & set(made)


def test_no_plan_holds_the_key(spark, capsys):
    df = spark.createDataFrame([(1, "Mr. John Smith, ssn 123456789, 12 Elm Street")], "doc_id long, text string")
    rows = pii.replace_pii(df, "very-secret-key")
    rows.explain(True)
    assert "very-secret-key" not in capsys.readouterr().out
    text = rows.first()["text"]
    assert re.fullmatch(r"Mr\. [A-Z]\w+ [A-Z]\w+, ssn \d{9}, \d\d [A-Z]\w+ Street", text) and "123456789" not in text and "Elm" not in text


def test_pii_edge_cases(spark, odd):
    long = "word " * 200_000 + "Mr. Quinlan Abbott. " + "x" * 100_000 + " Quinlan Abbott"
    rows = pii.replace_pii(odd.withColumns({"__segments": F.lit(1), "__row": F.lit(2), "__subs": F.lit(3), "kind": F.lit("k"), "at": F.lit(0)}), "key", count_col="ids").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((d or 0, t or "") for d, t, _ in ODD) and all(r["ids"] == 0 and r["__row"] == 2 for r in rows)
    out, n = replaced(spark, [long, None, ""])
    assert n == [2, 0, 0] and out[1:] == [None, ""] and "Abbott" not in out[0] and out[0].startswith("word " * 200_000)
    # a hot entity and repeated rows
    out, n = replaced(spark, ["ask a.b@c.org now"] * 3000 + [f"ask u{k}@c.org now" for k in range(3000)])
    assert len(set(out)) == 3001 and set(n) == {1}


def test_pii_of_nothing(spark, empty):
    assert pii.replace_pii(empty, "key").count() == 0


# ---- records


def test_a_shard_stored_twice_is_the_last_one(tmp_path, monkeypatch):
    """Also in a store that does not move onto a file that exists."""
    from pyarrow import fs

    class Store:
        def __init__(self):
            self.files = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.files, name)

        def move(self, source, target):
            if self.files.get_file_info(target).type != fs.FileType.NotFound:
                raise OSError("there is one already")
            self.files.move(source, target)

    for k, opened in enumerate([records._open, lambda uri: (Store(), uri.removeprefix("file://"))]):
        monkeypatch.setattr(records, "_open", opened)
        uri = f"file://{tmp_path}/shard{k}"
        records._put(uri, b"once")
        records._put(uri, b"again")
        assert records._get(uri) == b"again"
    assert sorted(f.name for f in tmp_path.iterdir()) == ["shard0", "shard1"]


def test_records_round_trip(spark, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/r"
    manifest = records.write_records(odd, WORDS, folder, shard_text_bytes=10_000)
    got = sorted(records.read_records(spark, folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5]
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    shard = manifest.first()["file"]
    content, index = (tmp_path / "r" / shard).read_bytes(), (tmp_path / "r" / (shard[:-4] + ".idx")).read_bytes()
    whole = list(records.read_shard(content))
    order = list(range(len(whole)))[::-1]
    assert list(records.read_shard(content, index, order)) == whole[::-1]
    for broken in (content[:12] + bytes([content[12] ^ 1]) + content[13:], content[:30] + bytes([content[30] ^ 1]) + content[31:]):
        with pytest.raises(ValueError):
            list(records.read_shard(broken))
    assert records.round_trip(empty, WORDS, f"file://{tmp_path}/e").count() == 0


def test_rows_of_one_id_fill_several_shards(spark, tmp_path):
    texts = [f"text number {i} of a hot id " * 3 for i in range(300)]
    rows = [(5, t) for t in texts] + [(None, t) for t in texts[:200]] + [(k, f"other {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/hot"
    manifest = records.write_records(df, WORDS, folder, shard_text_bytes=3000)
    assert manifest.agg(F.max("records")).first()[0] < 60
    got = sorted(records.read_records(spark, folder, manifest).collect(), key=lambda r: r["start"])
    t, at = WordTokenizer(WORDS), 0
    want = collections.Counter((d, zlib.crc32(np.array(t.tokenizer.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes())) for d, x in rows)
    assert collections.Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_record_query_by_brute_force(spark):
    t, at = WordTokenizer(WORDS), 0
    got = {r["doc_id"]: r for r in queries.op6_token_records(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = t.tokenizer.encode(r["text"], add_special_tokens=False).ids + [1]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# ---- near-duplicates


def shingles(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_signatures_are_unbiased():
    rnd, gap = random.Random(3), []
    for rep in range(80):
        a = [rnd.choice("abcdef") for _ in range(200)]
        b = list(a)
        for _ in range(rep // 8):
            b[rnd.randrange(200)] = "z"
        sig = bagminhash.signatures(bagminhash.Shingles([" ".join(a), " ".join(b)]))
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        gap.append((sig[0] == sig[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(gap)) < 0.02


def classes_by_brute_force(docs, threshold=0.8):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and sum((sets[a] & sets[b]).values()) >= threshold * sum((sets[a] | sets[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in docs}


def test_near_duplicate_classes(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs = {}
    base = [word() for _ in range(120)]
    for i in range(90):  # a large group of which many are near the base only
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(120)] = word()
        docs[i] = " ".join(w)
    for i in range(90, 130):
        docs[i] = " ".join(word() for _ in range(rnd.randint(0, 40)))
    docs |= {130: docs[100], 131: docs[100], 132: "one two", 133: "one two", 134: "", 135: None, 136: "one"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["id"]: r["class_id"] for r in bagminhash.near_duplicates(df).collect()}
    assert got == classes_by_brute_force(docs)


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.65, 0.9])
def test_near_duplicate_classes_at_other_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(bagminhash, "BLOCK", 7)
    monkeypatch.setattr(bagminhash, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(bagminhash, "SMALL", 5)
    rnd, docs = random.Random(int(threshold * 100)), {}
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    for g in range(12):
        base = [word() for _ in range(rnd.randint(30, 90))]
        for _ in range(10):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = word()
            docs[len(docs)] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["class_id"] for r in bagminhash.near_duplicates(df, threshold=threshold).collect()}
    assert got == classes_by_brute_force(docs, threshold)


def test_bands_follow_the_threshold():
    assert bagminhash.plan(0.8) == (16, 4, 64, 32)
    for t in (0.05, 0.3, 0.5, 0.65, 0.8, 0.95, 1.0):
        p = bagminhash.plan(t)
        assert (1 - t**p.rows) ** p.bands <= 2.5e-4 and p.bands * p.rows <= p.components


def test_rows_of_one_id_go_by_their_own_texts(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (2, a), (2, b), (3, b), (2, a)]
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["id"], r["class_id"], r["copy_of"]) for r in got.collect()) == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (2, 2, 2), (3, 2, 2)]


def test_near_duplicates_edge_cases(spark, odd, empty):
    got = sorted(tuple(r) for r in bagminhash.near_duplicates(odd).select(F.coalesce("id", F.lit(-1)), F.coalesce("class_id", F.lit(-1))).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert bagminhash.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(50, 49)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 120)}, 49: 49, 50: 49}


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_components_by_rounds_or_in_one_task(spark, one_task):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [tuple(draw.sample(range(1000, 1900), 2)) for _ in range(450)] + [(7, 7), (1, 0), (-5, 2000), (2000, -9)]
    least = {x: x for e in edges for x in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r["id"]: r["label"] for r in components.components(table, one_task=one_task).collect()} == least
    assert components.components(table.where("a is null"), one_task=one_task).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    # each job leaves plans and code on the driver
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = components.components(edges, 300)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == 301
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8


# ---- repeated windows


def cut_by_brute_force(docs, k=20):
    seen, out = set(), {}
    for i in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[i] or "")
        drop = [False] * len(w)
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            if x in seen:
                drop[j : j + k] = [True] * k
            seen.add(x)
        out[i] = (len(w), sum(drop), " ".join(a for a, d in zip(w, drop) if not d))
    return out


@pytest.mark.parametrize("vocabulary", [1, 2, 4, 30])
def test_repeated_windows(spark, vocabulary):
    rnd, docs = random.Random(vocabulary), {}
    for i in range(70):
        w = [rnd.choice("abcdefghijklmnopqrstuvwxyzABCD"[:vocabulary]) for _ in range(rnd.randint(0, 90))]
        if docs and rnd.random() < 0.6:
            o = docs[rnd.choice(list(docs))].split()
            a = rnd.randint(0, max(0, len(o) - 1))
            w = w[: rnd.randint(0, 30)] + o[a : a + rnd.randint(10, 60)] + w[30:]
        docs[i] = rnd.choice([" ", "\n", "  \t"]).join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = substrings.remove_repeats(df).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == cut_by_brute_force(docs)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in rows)


def test_repeated_windows_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in cut_by_brute_force(docs).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op8_substring_dedup(spark, SF).collect()} == want


def test_repeated_windows_edge_cases(spark, odd, empty):
    rows = substrings.remove_repeats(odd).collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["n_removed"] for r in rows}[4] == 20000 - 1  # all but the first word are in a window that started before
    assert {(r["n_words"], r["kept"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, "")}
    assert substrings.remove_repeats(empty).count() == 0
    clash = odd.withColumns({c: F.lit("x") for c in ("paths", "windows", "m", "h", "w", "first", "single", "n_words", "kept", "spans", "__key", "__cut", "__paths")})
    again = substrings.remove_repeats(clash)
    assert len(set(again.columns)) == len(again.columns) and sorted(r["kept"] for r in again.collect()) == sorted(r["kept"] for r in rows)
    assert {(r["paths"], r["__key"], r["windows"]) for r in again.collect()} == {("x", "x", "x")}


def test_collisions_of_windows_are_found_and_mended(spark):
    """Hashes of 5 bits collide at once; spans do not stand at their sources, and the next attempt has whole hashes."""
    rnd = random.Random(5)
    docs = {}
    for i in range(60):
        w = [rnd.choice("abc") for _ in range(rnd.randint(0, 120))]
        docs[i] = " ".join(w + (docs[rnd.randrange(i)].split()[:40] if i else []))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    coded = substrings._coded(df, "doc_id", "text", 0)
    rows = {r["id"]: r for r in substrings.repeated_windows(coded, bits=5).collect()}
    cut = [c for i, t in docs.items() for c in substrings._cut_block([t], [rows[i]["paths"] if i in rows else None], [rows[i]["windows"] if i in rows else None], 20, bits=5)]
    claims = [c for r in cut for c in r["claims"]]
    bad = sum(substrings._digest(docs[c["id"]].encode().split(), c["start"], c["length"]) != c["digest"] for c in claims)
    assert bad or not all(r["sound"] for r in cut)
    got = substrings.remove_repeats(df, widths=(5, 64)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == cut_by_brute_force(docs)
    with pytest.raises(ArithmeticError):
        substrings.remove_repeats(df, widths=(1,))


def test_pieces_become_nonbranching_paths(spark):
    """A passage of two documents is one path; where a third one leaves and enters it, nodes branch and paths end."""
    passage = [f"p{i}" for i in range(200)]
    own = [[f"{x}{i}" for i in range(30)] for x in "xyz"]
    docs = [(1, " ".join(own[0] + passage)), (2, " ".join(own[1] + passage))]
    df = substrings._coded(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 0)
    (row,) = substrings.repeated_windows(df).collect()
    sources = [row["paths"][i : i + 5] for i in range(0, len(row["paths"]), 5)]
    assert row["id"] == 2 and len(sources) > 10 and {(s[1], s[4]) for s in sources} == {(1, 30)}  # one path, from word 30 of document 1
    (cut,) = substrings._cut_block([docs[1][1]], [row["paths"]], [row["windows"]], 20)
    assert [(c["id"], c["start"], c["length"]) for c in cut["claims"]] == [(1, 30, 200)]
    # both ways on from word 100 of the passage repeat
    other = own[2] + passage[:100] + [f"q{i}" for i in range(60)]
    docs += [(3, " ".join(other)), (4, " ".join(["w"] + other))]
    df = substrings._coded(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 0)
    rows = {r["id"]: r for r in substrings.repeated_windows(df).collect()}
    (cut,) = substrings._cut_block([docs[1][1]], [rows[2]["paths"]], [rows[2]["windows"]], 20)
    assert len(cut["claims"]) > 1 and all(c["start"] + c["length"] <= 30 + 200 for c in cut["claims"])
    assert cut["n_removed"] == 200


# ---- quality


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("pmod(hash(doc_id), 2) = 0"), labels.where("pmod(hash(doc_id), 2) = 1")
    got = quality.quality(docs, train).join(held, "doc_id").select("quality", "q_keep").collect()
    assert sum(r["q_keep"] == (r["quality"] == 1) for r in got) / len(got) > 0.97
    assert all(r["q_keep"] for r in got if r["quality"] == 1)


def test_small_sites_shrink_to_their_prior(spark):
    rows = [("big", f"p{i % 3}", 0.9) for i in range(600)] + [("bad", "q", 0.1)] * 300 + [("tiny", "r", 0.1)]
    scored = spark.createDataFrame([(hash(h) % 10**9, hash(h + p) % 10**9, x) for h, p, x in rows], "__host long, __path long, __p double")
    site, strength = quality.site_priors(scored)
    means = {r["__host"]: r["hm"] for r in site.collect()}
    tiny, bad, big = (means[hash(h) % 10**9] for h in ("tiny", "bad", "big"))
    assert bad < 0.12 and big > 0.88 and bad < tiny < strength["mean"] + 0.3


def test_quality_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = quality.quality(odd, labels, host_col="ids", path_col=None).collect()
    assert len(rows) == len(ODD) and not any(r["q_keep"] for r in rows if not r["text"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(odd, none, host_col="ids", path_col="text").count() == len(ODD)
    assert quality.quality(empty, none, host_col="ids", path_col=None).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        frames.append(docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept, single, cut, private, packed = ({r["doc_id"]: r for r in f.collect()} for f in frames)
    classes = classes_by_brute_force({i: r["text"] for i, r in kept.items()})
    assert set(single) == set(classes.values())
    want = cut_by_brute_force({i: r["text"] for i, r in single.items()})
    for i, r in cut.items():
        assert r["text"] == (want[i][2] if want[i][1] else before[i]) and r["n_chars"] == len(r["text"])
    assert set(private) == set(cut) == set(packed)
    assert not any(re.search(r"mail\d\.example\.com", r["text"]) for r in private.values())


def test_pipeline_edge_cases(spark, empty):
    import corpus_pipeline

    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, a, 7), (2, a, 7), (2, b, 7), (2, b, 7), (3, None, 7), (3, None, 7), (4, "", 7), (None, a, 7)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), x) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, __h int")
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in out.collect()) == [(0, a), (1, a), (2, b), (3, ""), (3, ""), (4, "")]
    frames = [docs, docs.limit(0)]
    for name, stage in corpus_pipeline.STAGES:
        frames = [corpus_pipeline.materialize(stage(spark, f, SF), name) for f in frames]
        assert frames[1].count() == 0
