"""Persons and places that no title announces: a sequence tagger fitted here, as an adapter of the detection.

It is fitted by a distributed fold: lines are dealt to shards, each shard makes one pass of a structured perceptron from
the same weights, the shards' changes are added up by Spark, and the next pass starts from their mean. The weights kept are the average
over all passes. Everything is whole numbers and the shards are fixed, so one set of lines gives one model.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillmill.functions import spans
from quillmill.functions import tagging as G
from quillmill.operators import name_lines
from quillmill.sources.shared import written

SHARDS, PASSES = 8, 5
#: As sure as the pattern of a name behind a title.
SCORE = 0.85
#: Texts of a batch that are Python strings at once.
SOME = 64
LINES = "id long, words array<string>, tags array<string>"


def labelled(spark: SparkSession, n: int = 6000, held_out: bool = False) -> DataFrame:
    """``id, words, tags`` of ``n`` made lines; held-out ones have other sentences, names and places."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            lines = [name_lines.line(random.Random(f"{held_out} {i}"), held_out) for i in ids]
            yield pa.RecordBatch.from_pydict({"id": ids, "words": [w for w, _ in lines], "tags": [t for _, t in lines]})

    return spark.range(n).mapInArrow(make, LINES)


def fit(lines: DataFrame, passes: int = PASSES, shards: int = SHARDS) -> G.Model:
    """The tagger of labelled lines ``(id, words, tags)``; at most ``BUCKETS`` rows of weights come to the driver, however many lines there are."""
    spark = lines.sparkSession
    dealt = written(lines.where("size(words) > 0").repartition(shards, F.xxhash64("id")), "lines").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "id")
    rows, step, total_rows, total_step, seen = np.zeros((G.BUCKETS, len(G.TAGS)), np.int64), G.steps(), 0, 0, 0
    for _ in range(passes):
        at = spark.sparkContext.broadcast((rows, step))

        def one(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            mine: dict[int, list] = {}
            for b in batches:
                for s, w, t in zip(b.column(3).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    mine.setdefault(s, []).append((w, t))
            for some in mine.values():
                change, average, n = G.learn(some, *at.value, shards)
                keys = list(change)
                yield pa.RecordBatch.from_pydict({"row": [*(k[0] for k in keys), G.BUCKETS], "tag": [*(k[1] for k in keys), 0], "change": [*(change[k] for k in keys), n], "average": [*(average[k] for k in keys), 0]})

        parts = dealt.mapInArrow(one, "row long, tag long, change long, average long").groupBy("row", "tag").agg(F.sum("change").alias("change"), F.sum("average").alias("average"))
        got = np.array([tuple(r) for r in parts.collect()], dtype=np.int64).reshape(-1, 4)
        n = int(got[got[:, 0] == G.BUCKETS, 2].sum())
        # the sum over all lines of all shards of the weights at that line
        total_rows, total_step, seen = total_rows + n * rows, total_step + n * np.where(step > G.NEVER // 2, step, 0), seen + n
        rows, step = rows.copy(), step.copy()
        for target, sums, mine in ((rows, total_rows, (got[:, 0] >= 0) & (got[:, 0] < G.BUCKETS)), (step, total_step, got[:, 0] < 0)):
            place = np.where(got[mine, 0] < 0, -1 - got[mine, 0], got[mine, 0]), got[mine, 1]
            target[place] += got[mine, 2] // shards  # the mean of the shards, as each learns by steps of their number
            sums[place] += got[mine, 3]
        at.unpersist()
    return G.Model(total_rows, np.where(G.steps() < 0, G.NEVER, total_step))


_FITTED: dict[int, G.Model] = {}


def fitted(spark: SparkSession, n: int = 6000) -> G.Model:
    """The tagger of ``n`` made lines, fitted once a process."""
    if n not in _FITTED:
        _FITTED[n] = fit(labelled(spark, n))
    return _FITTED[n]


def tagger(spark: SparkSession, model: G.Model | None = None):
    """A Column function from a text to its spans of persons and places; a null or empty text has none."""
    at = spark.sparkContext.broadcast(model or fitted(spark))
    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    @arrow_udf(spans.TYPE)
    def tagged(texts: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(texts), SOME):
            listed = texts.slice(i, SOME).to_pylist()
            rows = [
                [{"entity_type": k, "start": a, "end": b, "score": SCORE, "text": text[a:b]} for k, a, b in found] for text, found in zip(listed, at.value.entities(listed))
            ]
            parts.append(pa.array(rows, kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return tagged


def quality(lines: DataFrame, model: G.Model) -> DataFrame:
    """``kind, right, found, wanted, precision, recall`` by whole entities of labelled lines."""
    at = lines.sparkSession.sparkContext.broadcast(model)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, tags = b.column("words").to_pylist(), b.column("tags").to_pylist()
            lengths = np.array([len(w) for w in words])
            guess = [G.TAGS[t] for t in at.value.tag([w for ws in words for w in ws], lengths)] if lengths.sum() else []
            want = _entities([t for ts in tags for t in ts], lengths)
            got = _entities(guess, lengths)
            yield pa.RecordBatch.from_pydict({"kind": list(G.KINDS), "right": [len(want[k] & got[k]) for k in G.KINDS], "found": [len(got[k]) for k in G.KINDS], "wanted": [len(want[k]) for k in G.KINDS]})

    sums = lines.mapInArrow(compare, "kind string, right long, found long, wanted long").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("right", "found", "wanted")])
    return sums.withColumns({"precision": F.try_divide("right", "found"), "recall": F.try_divide("right", "wanted")})


def _entities(tags: list[str], lengths: np.ndarray) -> dict[str, set[tuple[int, int]]]:
    borders = set(np.cumsum(lengths).tolist())
    out: dict[str, set[tuple[int, int]]] = {k: set() for k in G.KINDS}
    for i, t in enumerate(tags):
        if t[0] == "B":
            j = i + 1
            while j < len(tags) and j not in borders and tags[j] == f"I-{t[2:]}":
                j += 1
            out[t[2:]].add((i, j))
    return out
