"""What the two metric indexes share: vectors, inner products as distances, shards on the shared folder, merging.

A vector v gets one more component, sqrt(M - |v|^2), with M the largest |v|^2 of its shard, and a query gets
a zero. Then |q' - v'|^2 = |q|^2 + M - 2 q.v, so the nearest in this metric space are those of the
largest inner product, and the triangle inequality holds.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.shared import fresh_dir, materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 512
#: Points that clusters lie around: at most so many a length of vectors, lengths, and bytes altogether.
PIVOTS, LENGTHS, PIVOT_BYTES = 256, 64, 16 << 20
#: Rows of a table that goes to all tasks, counted first; a larger one is joined by its key.
BROADCAST_ROWS = 200_000
#: Tasks of a costly stage at most.
TASKS = 4096


class Best:
    """The k best (score, id) so far: higher scores first, smaller ids among equals; nothing below ``floor`` counts."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor, self.heap = k, floor, []

    @property
    def worst(self) -> float:
        return self.heap[0][0] if len(self.heap) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        heap, k = self.heap, self.k
        if scores.min() < self.floor or scores.min() == -np.inf:
            scores, ids = scores[few := (scores >= self.floor) & (scores > -np.inf)], ids[few]
            if not len(scores):
                return
        if len(heap) == k:
            if scores.max() < heap[0][0]:
                return
            few = scores >= heap[0][0]
            scores, ids = scores[few], ids[few]
        if len(scores) > 4 * k:
            # only the k-th score and better can matter; equals are told apart by their ids below
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            few = scores >= least
            scores, ids = scores[few], ids[few]
            if len(scores) > 4 * k:
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
        for s, i in zip(scores.tolist(), ids.tolist()):
            if len(heap) < k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))

    def rows(self) -> list[tuple[int, float]]:
        return [(-i, s) for s, i in self.heap]


def in_order(rows: np.ndarray, query: np.ndarray, scores: np.ndarray, worst: float, k: int) -> np.ndarray:
    """The scores with those that may count computed anew, each added up from the first component to the last.

    So equal vectors have equal scores wherever they lie. ``scores`` may be off by a rounding; of them only
    those near the k best here and ``worst`` or better can count, the others come back below ``worst``.
    """
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    least = max(least, worst)
    if least == -np.inf:
        return np.cumsum(rows * query, axis=1)[:, -1]
    near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    out = np.full(len(scores), -np.inf)
    out[near] = np.cumsum(rows[near] * query, axis=1)[:, -1]
    return out


def lifted(v: np.ndarray) -> np.ndarray:
    """The vectors with their additional component."""
    square = np.einsum("ij,ij->i", v, v)
    most = square.max() if len(square) else 0.0
    return np.hstack([v, np.sqrt(np.maximum(most - square, 0))[:, None]])


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v array<double>`` of the rows that take part: no null, no component that is null or not finite."""
    v = F.col(vector_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ok)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _matrix(table) -> np.ndarray:
    column = table.column("v").combine_chunks() if isinstance(table, pa.Table) else table.column("v")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pivots(data: DataFrame, shard_rows: int) -> dict[int, tuple[np.ndarray, float]]:
    """Per frequent length of vectors: points that its clusters lie around, and the largest square of its vectors.

    At most ``LENGTHS`` lengths, the most frequent ones of more rows than a shard, with ``PIVOT_BYTES`` of points
    altogether; a length beyond these is one cluster. The points are the different vectors of the least hash.
    """
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    lengths = (
        data.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("most"))
        .where(F.col("n") > shard_rows).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    )
    out = {}
    for r in lengths:
        number = min(PIVOTS, -(-r["n"] // shard_rows), PIVOT_BYTES // (8 * r["dim"] * len(lengths)))
        if number > 1 and np.isfinite(r["most"]):
            # some 20 times as many rows as points are looked at, so that equal vectors leave enough
            share = min(1 << 30, (20 * number << 30) // r["n"] + 1)
            some = data.where((F.size("v") == r["dim"]) & (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share))
            points = [x["v"] for x in some.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(number).collect()]
            if len(points) > 1:
                out[r["dim"]] = (np.array(points), r["most"])
    return out


def _raised(v: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", v, v), 0))[:, None]])


def _clustered(rows: DataFrame, pivots: dict) -> DataFrame:
    """``rows`` with the ``cluster`` of the nearest point and the distance ``far`` from it."""

    def assign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cluster, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim not in pivots:
                    continue
                own = np.flatnonzero(dims == dim)
                points, most = pivots[dim]
                x, to = _raised(_matrix(batch.take(pa.array(own))), most), _raised(points, most)
                near = ((to**2).sum(1) - 2 * x @ to.T).argmin(1)
                cluster[own], far[own] = near, np.sqrt(((x - to[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(far)], [*batch.schema.names, "cluster", "far"])

    if not pivots:
        return rows.withColumn("cluster", F.lit(0)).withColumn("far", F.lit(0.0))
    return rows.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cluster int, far double")


def search(
    data: DataFrame,
    queries: DataFrame,
    k: int,
    build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    find: Callable[..., list[tuple[int, float]]],
    factor: float = 1.0,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, id, score``: for each query the k best of all rows but those with its own id.

    Equal rows are counted first and stand for min(k, their number) rows, as more cannot be among k answers.
    Rows lie in clusters around a bounded number of points, clusters in shards of about ``shard_rows`` rows.
    A task builds a shard's tree with ``build(ids, vectors)`` and leaves it in the shared folder. A query, in
    blocks of a bounded number, goes to the shards of its own cluster first, where ``find(tree, query_id,
    query, k, floor)`` answers; its k-th score there rules out clusters whose ball lies too far away
    (by ``factor`` times less than it seems; 1 loses nothing), and is the floor in all others. Vectors of
    different lengths are not compared. A repeated query is asked once; different vectors of one id are
    different queries.
    """
    spark = data.sparkSession
    pivots = _pivots(data, shard_rows)
    # equal rows are added up where they are read; no row's key can then hold much
    rows = data.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")).withColumn("dim", F.size("v"))
    rows = materialize(_clustered(rows, pivots), "vectors")
    clusters = rows.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), F.max("far").alias("radius"))
    clusters = materialize(clusters, "clusters", 1)
    shards, number = clusters.agg(F.coalesce(F.sum("shards"), F.lit(0)), F.count("*")).first()
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    # as many clusters as points, but a length without points has one too: counted before it is sent
    side = F.broadcast(clusters) if number <= BROADCAST_ROWS else clusters
    radius = {(r["dim"], r["cluster"]): r["radius"] for r in clusters.where(F.col("dim").isin(list(pivots))).collect()}
    folder = fresh_dir(spark, "trees")
    files, path = _files(folder)
    files.create_dir(path, recursive=True)

    def store(key, table):
        dim, cluster, shard = (x.as_py() for x in key)
        copies = table.column("copies").to_numpy()
        ids, vectors = np.repeat(table.column("id").to_numpy(), copies), np.repeat(_matrix(table), copies, axis=0)
        order = np.lexsort((*vectors.T[:3], ids))  # the same tree whatever order the rows come in
        out = io.BytesIO()
        np.savez(out, **build(ids[order], vectors[order]))
        to, where = _files(f"{folder}/{dim}-{cluster}-{shard}.npz")
        own = f"{where}.{uuid.uuid4().hex}.tmp"
        with to.open_output_stream(own) as stream:
            stream.write(out.getvalue())
        to.move(own, where)
        return pa.table({"dim": pa.array([dim], pa.int32())})

    dealt = rows.join(side, ["dim", "cluster"]).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int"))
    keys = ["dim", "cluster", "shard"]
    # a fixed number of tasks: adaptive execution would put small inputs with costly work into one
    stored = dealt.select(*keys, "id", "v", "copies").repartition(min(shards, TASKS), *keys).groupBy(*keys).applyInArrow(store, "dim int")
    stored.write.format("noop").mode("overwrite").save()  # every shard's file is in place from here on

    asked = queries.distinct().select(F.size("v").alias("dim"), "id", "v", F.xxhash64("v").alias("twin"))
    parts = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = _clustered(asked.withColumn("part", F.pmod(F.xxhash64("id", "twin"), F.lit(parts)).cast("int")), pivots).drop("far")

    def answer(key, table):
        dim, cluster, shard = (x.as_py() for x in key[:3])
        source, where = _files(f"{folder}/{dim}-{cluster}-{shard}.npz")
        with source.open_input_stream(where) as stream:
            tree = dict(np.load(io.BytesIO(stream.read())))
        each = zip(table.column("id").to_pylist(), table.column("twin").to_pylist(), table.column("floor").to_numpy(), _matrix(table))
        found = [(q, t, *hit) for q, t, floor, v in each for hit in find(tree, q, v, k, floor)]
        columns = list(zip(*found)) if found else [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "twin", "id", "score"])

    def answered(routed: DataFrame) -> DataFrame:
        spread = routed.join(side, ["dim", "cluster"]).select(*keys[:2], F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "part", "id", "twin", "floor", "v")
        by = [*keys, "part"]
        return spread.repartition(min(shards * parts, TASKS), *by).groupBy(*by).applyInArrow(answer, "query_id long, twin long, id long, score double")

    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "id")
    found = answered(asked.withColumn("floor", F.lit(float("-inf"))))
    if pivots:
        found = materialize(found, "answers")
        floors = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "twin", F.col("score").alias("floor"))
        again = asked.join(floors, ["id", "twin"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        columns = ["dim", "part", "id", "twin", "v", "floor"]

        def route(batches):
            for batch in batches:
                dims, home, floor = (batch.column(c).to_numpy() for c in ("dim", "cluster", "floor"))
                for dim in np.unique(dims).tolist():
                    if dim not in pivots:
                        continue
                    own = np.flatnonzero(dims == dim)
                    points, most = pivots[dim]
                    to, q = _raised(points, most), _matrix(batch.take(pa.array(own)))
                    square = np.einsum("ij,ij->i", q, q)
                    reach = np.where(floor[own] > -np.inf, np.sqrt(np.maximum(square + most - 2 * np.maximum(floor[own], -1e300), 0)), np.inf)
                    reach += 1e-7 * np.maximum(1.0, np.sqrt(square + most))
                    for c in range(len(points)):
                        if (dim, c) in radius:
                            away = np.sqrt(((np.pad(q, ((0, 0), (0, 1))) - to[c]) ** 2).sum(1)) - radius[dim, c]
                            rows = own[(away * factor <= reach) & (home[own] != c)]
                            if len(rows):
                                some = batch.take(pa.array(rows)).select(columns)
                                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(rows), c, np.int32))], [*columns, "cluster"])

        routed = again.mapInArrow(route, "dim int, part int, id long, twin long, v array<double>, floor double, cluster int")
        found = found.unionByName(answered(routed))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    )
