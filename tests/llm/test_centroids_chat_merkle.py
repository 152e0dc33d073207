"""Centroid clustering, chat formatting and the Merkle manifest by brute force, round trips and their edge cases."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import centroids, chat, merkle, queries

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_centroids", "op12_chat", "op13_merkle"])
def test_query_by_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r[x] for x in want.columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted(want.fetchall(), key=repr)


# ---- centroids


def brute_nearest(p, points):
    return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(points))


@pytest.mark.parametrize("reach", [100, 2**22, 2**24, 2**27, 2**29, 2**40, 10**30])
def test_nearest_is_exact_at_every_magnitude(reach):
    rnd = random.Random(reach)
    rows = [[float(rnd.randint(-reach, reach)) for _ in range(64)] for _ in range(40)]
    rows += [[float(rnd.randint(-3, 3)) for _ in range(64)] for _ in range(10)] + rows[:3]
    points = [[int(v) for v in r] for r in rows[:4]] + [[int(v) + 1 for v in rows[0]], [0] * 64, [0] * 64]
    cluster, distance = centroids.nearest(np.array(rows), centroids.Centroids(points))
    for row, j, d in zip(rows, cluster, distance):
        assert (d, j) == brute_nearest([int(v) for v in row], points)


def brute_clusters(rows, k, rounds, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))
    points = [p for _, p in order[:k]]
    for _ in range(rounds):
        mine = [brute_nearest(p, points)[1] for _, p in kept]
        for j in range(len(points)):
            members = [p for (_, p), m in zip(kept, mine) if m == j]
            if members:
                points[j] = [sum(c) // len(members) for c in zip(*members)]
    last = [brute_nearest(p, points) for _, p in kept]
    out = []
    long = lambda n: n if n < 2**63 else None
    for (i, _), (d, j) in zip(kept, last):
        out.append((i, j, long(d), long(sum(e for e, m in last if m == j)), long(sum(e for e, _ in last)), sha(",".join(map(str, points[j])))))
    return sorted(out, key=repr)


def odd_vectors(n, big):
    rnd = random.Random(n)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(64)]) for i in range(n)]
    rows += rows[:5] + [(3, rows[-1][1]), (None, rows[1][1]), (None, [0.5] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [1.7e308] * 63)]
    return rows + [(1000 + i, [x * big for x in rows[i][1]]) for i in range(4 if big else 0)]


@pytest.mark.parametrize("n,big", [(60, 0), (60, 2.0**30), (40, 1e30), (2, 0)])
def test_clusters_by_brute_force(spark, n, big):
    rows = odd_vectors(n, big)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"point": F.lit(1), "cluster": F.lit("x"), "id": F.lit(None)})
    got = centroids.clusters(table.repartition(5), k=4, rounds=6)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, 4, 6)


def test_clusters_of_too_few_and_of_none(spark):
    three = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    assert [r["distance"] for r in centroids.clusters(three).collect()] == [0, 0, 0]
    assert centroids.clusters(three.where("vec_id > 5")).collect() == []
    overflow = spark.createDataFrame([(1, [1.7e308] * 64)], "vec_id long, embedding array<double>")
    assert centroids.clusters(overflow).collect() == []


# ---- chat


def test_paths_of_records_are_those_of_schemas(spark):
    record = '{"messages": [{"role": "user", "content": "x"}, {"role": null, "content": "a: STRING, b", "m x": 1.5}], "deep": {"a`b": [[{"STRING": true}]], "e": {}}, "id": 3}'
    got = spark.createDataFrame([(record,)], "j string").select(chat.record_paths(F.parse_json("j"))).first()[0]
    assert sorted(got) == ["deep.a`b[][].STRING", "id", "messages[].content", "messages[].m x", "messages[].role"]
    table = spark.sql("select array(named_struct('role', 'user', 'content', 'x')) as messages, 3 as id, map('a', 1) as m")
    assert sorted(chat.schema_paths(table.schema)) == ["id", "m", "messages[].content", "messages[].role"]


U, A, S = "user", "assistant", "system"
LAYOUTS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [(U, "hi"), (A, "")]),
    ({"system": "be", "messages": [{"role": "tool", "content": "hi"}], "id": 1, "meta": {"a": [1]}}, "messages", [(S, "be"), ("tool", "hi")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message_parts", [(U, "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "GPT", "value": "a"}, {"from": "narrator", "value": ""}]}, "shared", [(U, "q"), (A, "a"), ("narrator", "")]),
    ({"conversation": [{"input": "q", "output": "a"}, {"input": "r", "output": "b"}], "system": None}, "exchanges", [(U, "q"), (A, "a"), (U, "r"), (A, "b")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [(U, "do"), (A, "done")]),
    ({"instruction": "do", "input": "it", "output": "done", "history": [["q", "a"]]}, "instruction", [(U, "q"), (A, "a"), (U, "do\n\nit"), (A, "done")]),
    ({"prompt": "p", "completion": "c"}, "completion", [(U, "p"), (A, "c")]),
    ({"prompt": "p", "response": "[{\"role\": 1}]"}, "response", [(U, "p"), (A, "[{\"role\": 1}]")]),
    ({"question": "q", "answer": 42, "context": "c"}, "question", [(U, "c\n\nq"), (A, "42")]),
    ({"prompt": "p", "completion": "c", "messages": [{"role": "user", "content": "x"}]}, None, []),
    ({"nothing": 1}, None, []),
    ({"messages": []}, None, []),
]


def test_records_of_many_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)] + [(100, None), (101, ""), (102, "no json"), (103, "[1]"), (104, '"x"')]
    table = spark.createDataFrame(rows, "id long, record string").withColumns({"layout": F.lit(1), "__record": F.lit(2), "__print": F.lit(3)})
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.turns_of_records(table).collect()}
    assert len(got) == len(rows)
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[i] == (layout, turns)
    assert all(got[i] == (None, []) for i in range(100, 105))


def test_a_schema_selects_the_mapping_of_a_table(spark):
    one = spark.createDataFrame([("do", None, "done", "x")], "instruction string, input string, output string, turns string")
    r = chat.turns_of_table(one).first()
    assert (r["layout"], [tuple(t) for t in r["turns"]]) == ("instruction", [(U, "do"), (A, "done")])
    nested = spark.sql("select array(named_struct('value', 'q', 'from', 'human'), named_struct('value', 'a', 'from', 'gpt')) as conversations")
    assert [tuple(t) for t in chat.turns_of_table(nested).first()["turns"]] == [(U, "q"), (A, "a")]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.range(1))


def test_rows_of_turns(spark):
    rows = [(1, 2, A, "b"), (1, 1, U, None), (1, None, S, "first"), (1, 2, A, "b"), (2, 0, None, ""), (None, 0, U, "lone"), (None, 0, U, "lone"), (3, 0, U, "w " * 500_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(1))
    out = chat.formatted(chat.turns_of_table(table))
    got = out.select("conv_id", "turns", chat.parsed(F.col("formatted")).alias("back"), chat.under_loss(F.col("segments")).alias("loss")).collect()
    assert all(r["turns"] == r["back"] for r in got)
    by = {r["conv_id"]: r for r in got}
    assert [tuple(t) for t in by[1]["turns"]] == [(S, "first"), (U, ""), (A, "b"), (A, "b")] and by[1]["loss"] == "bb"
    assert [tuple(t) for t in by[2]["turns"]] == [("", "")] and len(by[3]["turns"][0]["text"]) == 1_000_000
    assert sum(r["conv_id"] is None for r in got) == 2
    assert chat.formatted(chat.turns_of_table(table.where("conv_id > 9"))).collect() == []


T = chat.Template()
PIECES = [*T.controls, "\\", "\\\\", "<", "[", ">", "<|", "|>", "</", "<<", "/s>", "a", "\n", "漢", "🙂", "$1", "INST]", "<\\", "[\\/INST]"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([U, A, S, "</s>", "<|text|>"]), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5), min_size=1, max_size=20))
def test_templates_are_read_back(spark, talks):
    table = spark.createDataFrame([(i, [{"role": r, "text": t} for r, t in talk]) for i, talk in enumerate(talks)], f"id int, turns {chat.TURNS}")
    out = chat.formatted(table).select("id", "formatted", "segments", chat.parsed(F.col("formatted")).alias("back"), chat.under_loss(F.col("segments")).alias("loss"))
    for r in out.collect():
        talk = talks[r["id"]]
        assert [tuple(t) for t in r["back"]] == talk
        assert r["loss"] == "".join(t for role, t in talk if role == A)
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count(T.start) == r["formatted"].count(T.text) == r["formatted"].count(T.end) == len(talk)
        assert not any(c in r["formatted"] for c in T.others)


def test_templates_that_cannot_be_read_back_are_refused():
    for bad in ({"start": "x"}, {"end": "<\\>"}, {"text": "<<>"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_formatting_runs_no_python(spark):
    plan = queries.op12_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[conv_id", "")


# ---- Merkle


def brute_tree(digests):
    """The root and each leaf's siblings, level by level, over the whole list."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 16 * 16
            p.append((nodes[run : at[i]], nodes[at[i] + 1 : run + 16]))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0] if nodes else None, paths


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096])
def test_a_block_is_traversed_like_levels(n):
    digests = [sha(str(i)) for i in range(n)]
    root, proofs = merkle.traverse(digests, merkle.height_of(n), "")
    want, paths = brute_tree(digests)
    assert root == want
    assert proofs == ["".join(f"{''.join(a)}:{''.join(b)}," for a, b in p) for p in paths]


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], sha("".join(map(part, r)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        leaves = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = (leaves, *brute_tree([d for _, d in leaves]))
    root, tops = brute_tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        leaves, sub, paths = trees[s]
        for (i, d), p in zip(leaves, paths):
            out.append((i, s, d, sub, root, "".join(x for a, b in p + top for x in a + b)))
    return sorted(out, key=repr)


def test_manifest_by_brute_force(spark):
    rows = [(i, "hot", "en", i, f"text {i}") for i in range(5000)] + [(i, None, None, None, None) for i in range(17)] + [(i, "", "x", 1, "") for i in range(3)]
    rows += [(None, "hot", "en", 1, "no id")] * 3 + [(7, "hot", "en", 7, "text 7"), (7, "hot", "en", 7, "other"), (1, "é", "x", 1, "w " * 100_000), (1, "z", "x", 1, "Ünïcode 🙂")]
    rows += [(i, f"s{i}", "x", i, "lone") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"g": F.lit(1), "at": F.lit(2), "leaf": F.lit("x"), "__carry_0": F.lit(4)})
    got = merkle.manifest(table.repartition(7), carry=("n_chars",))
    folded = got.select("id", "group", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("s"), merkle.fold(F.col("leaf"), F.col("proof")).alias("folded"), "n_chars").collect()
    assert sorted((tuple(r)[:6] for r in folded), key=repr) == brute_manifest(rows)
    assert all(r["folded"] == r["root"] for r in folded)
    assert sorted(str(r["n_chars"]) for r in folded) == sorted(str(r[3]) for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "x", 1, "t")], [(1, None, None, None, None)] * 2])
def test_manifest_of_few_rows(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(table).withColumn("proof", merkle.siblings(F.col("proof"))).collect()
    assert sorted(map(tuple, got), key=repr) == (brute_manifest(rows) if rows else [])


def test_a_changed_row_fails_its_proof(spark):
    got = queries.op13_merkle(spark, SF).collect()
    assert {r["verified"] for r in got} == {True, False}
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and len({r["root"] for r in got}) == 1
