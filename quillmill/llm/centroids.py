"""Clusters around centroids over vectors of whole numbers, without rounding anywhere.

Distances of a block of rows to all centroids are one matrix product, ``|x|^2 - 2 x c + |c|^2``. Every term and every partial sum
is a whole number, so double precision is exact as long as a bound on the magnitudes stays below 2^53; rows beyond it
are computed in integers, of 64 bits where they suffice and without a bound otherwise. Each task reduces its rows to sums per
centroid, and a tree of tasks adds those up.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillmill.llm.shared import discard, materialize

#: Rows of a matrix product.
BLOCK = 8192
#: Half of 2^53 and of 2^63, so that rounding of the bound itself does not matter.
EXACT, LONG = 2.0**52, 2.0**62


def whole(vector: Column, dims: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component as doubles; null unless there are ``dims`` components, none null or not finite.

    A component so large that its multiple is no finite double counts as not finite.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) == dims) & ~bad, scaled)


class Centroids:
    """Centroids as Python integers, and as doubles where these hold them exactly."""

    def __init__(self, points: list[list[int]]):
        self.points = points
        self.reach = float(max((abs(v) for p in points for v in p), default=0))
        self.array = np.array(points, dtype=np.float64).reshape(len(points), -1)
        self.norms = (self.array * self.array).sum(axis=1) if self.reach < 2.0**26 else None

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in self.points]


def integers(x: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as Python integers."""
    return np.frompyfunc(int, 1, 1)(x)


def _direct(x: np.ndarray, points: list[list[int]], kind) -> np.ndarray:
    return np.stack([((x - np.array(p, dtype=kind)) ** 2).sum(axis=1) for p in points], axis=1)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of each row, the smaller number among equals, and the squared distance."""
    reach = np.abs(x).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        bound = x.shape[1] * (reach + centroids.reach) ** 2
    cluster, distance = np.zeros(len(x), dtype=np.int64), [0] * len(x)
    tiers = ((bound < EXACT, None), ((bound >= EXACT) & (bound < LONG), np.int64), (bound >= LONG, object))
    for chosen, kind in tiers:
        rows = np.flatnonzero(chosen)
        if not len(rows):
            continue
        y = x[rows]
        if kind is None:
            d = (y * y).sum(axis=1)[:, None] - 2.0 * (y @ centroids.array.T) + centroids.norms
        else:
            d = _direct(integers(y) if kind is object else y.astype(kind), centroids.points, kind)
        best = d.argmin(axis=1)
        cluster[rows] = best
        for r, v in zip(rows.tolist(), d[np.arange(len(rows)), best].tolist()):
            distance[r] = int(v)
    return cluster, distance


def _blocks(columns: Iterator[pa.Array], dims: int) -> Iterator[np.ndarray]:
    for column in columns:
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for at in range(0, len(flat), BLOCK):
            yield np.floor(flat[at : at + BLOCK])


class Sums:
    """Rows, sums of components and distances of each centroid, in integers without a bound."""

    def __init__(self, k: int, dims: int):
        self.counts, self.totals, self.inertia = [0] * k, np.full((k, dims), 0, dtype=object), [0] * k

    def add(self, x: np.ndarray, centroids: Centroids) -> None:
        cluster, distance = nearest(x, centroids)
        small = len(x) * np.abs(x).max(initial=0.0) < EXACT
        member = cluster == np.arange(len(self.counts))[:, None]
        if small:
            self.totals += integers(member.astype(np.float64) @ x)
        else:
            y = integers(x)
            for j, rows in enumerate(member):
                self.totals[j] += y[rows].sum(axis=0) if rows.any() else 0
        for j, d in zip(cluster.tolist(), distance):
            self.counts[j] += 1
            self.inertia[j] += d

    def join(self, other: Sums) -> Sums:
        self.counts = [a + b for a, b in zip(self.counts, other.counts)]
        self.inertia = [a + b for a, b in zip(self.inertia, other.inertia)]
        self.totals = self.totals + other.totals
        return self


def summed(points: DataFrame, centroids: Centroids, dims: int) -> Sums:
    """The sums over all rows: one row a task, then a tree of tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Sums(len(centroids.points), dims)
        for x in _blocks((b.column(0) for b in batches), dims):
            mine.add(x, centroids)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary())], ["part"])

    parts = points.select("point").mapInArrow(part, "part binary").rdd.map(lambda r: pickle.loads(r["part"]))
    return parts.treeAggregate(Sums(len(centroids.points), dims), Sums.join, Sums.join)


def _long(value: int) -> int | None:
    return value if value < 2**63 else None


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of ``dims`` usable components.

    The first centroids are the ``k`` vectors with the least SHA-256 of ``seed:id``; each of ``rounds`` rounds assigns all
    vectors and moves every centroid that has some to the floor of their mean. Rounds end early where no centroid moves,
    which changes nothing. Only ``k`` centroids and their sums come to the driver.

    Vectors null, of another length or with a component null or not finite are no rows of the result. Of fewer than ``k``
    vectors each is a first centroid; an empty table has an empty result. Rows without an id are assigned, but start no
    centroid unless there are too few others. Repeated rows count as often as they stand there; equal hashes go by components. Other
    columns do not come along. A distance or an inertia that a long cannot hold is null; assignments are exact all the same.
    """
    usable = vectors.select(F.col(id_col).alias("id"), whole(F.col(vector_col), dims, scale).alias("point")).where("point is not null")
    points = materialize(usable, "points")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = points.orderBy(place.asc_nulls_last(), F.transform("point", lambda x: F.floor(x))).select("point").limit(k).collect()
    schema = StructType(
        [points.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType()), StructField("cluster_inertia", LongType()),
         StructField("inertia", LongType()), StructField("centroid_sha256", StringType())]
    )
    if not first:
        discard(points)
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = Centroids([[math.floor(v) for v in r["point"]] for r in first])
    for _ in range(rounds):
        got = summed(points, centroids, dims)
        moved = [[int(t) // n for t in total] if n else old for old, total, n in zip(centroids.points, got.totals.tolist(), got.counts)]
        if moved == centroids.points:
            break
        centroids = Centroids(moved)
    last = summed(points, centroids, dims).inertia
    per, total, digests = [_long(v) for v in last], _long(sum(last)), centroids.digests()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for x in _blocks(iter([b.column(1)]), dims):
                cluster, distance = nearest(x, centroids)
                mine = cluster.tolist()
                columns = [
                    b.column(0).slice(at, len(x)), pa.array(mine, pa.int32()), pa.array(map(_long, distance), pa.int64()), pa.array([per[j] for j in mine], pa.int64()),
                    pa.array([total] * len(x), pa.int64()), pa.array([digests[j] for j in mine], pa.string()),
                ]
                at += len(x)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return points.mapInArrow(assign, schema)
