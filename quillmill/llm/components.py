"""Connected components of an edge table: forests of tasks, then one task, or least labels and pointer jumping where the forests are large."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.shared import discard, heavy_join, materialize, release


#: Forests of no more edges in all are joined in one task.
ONE_TASK = 500_000
#: Rows of a batch of labels.
LABELS = 10_000


def _join(batches, root: dict[int, int]):
    """The edges, batch by batch, that join what earlier ones have not joined; ``root`` leads to the least id."""

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for batch in batches:
        kept = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((a, b))
        yield kept


def _pairs(pairs: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names)


def _forest(batches):
    """Of a task's edges those that join what its earlier ones have not joined."""
    for kept in _join(batches, {}):
        if kept:
            yield _pairs(kept, ["a", "b"])


def _labels(batches):
    """All ids of a task's edges with the least ids that they reach."""
    root: dict[int, int] = {}
    for kept in _join(batches, root):
        for a, b in kept:
            root.setdefault(a, a), root.setdefault(b, b)
    # a root is less than what it is the root of, so in this order each id's root is final
    ids = sorted(root)
    for x in ids:
        root[x] = root[root[x]]
    for i in range(0, len(ids), LABELS):
        yield _pairs([(x, root[x]) for x in ids[i : i + LABELS]], ["id", "label"])


def components(edges: DataFrame, rows: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """``id, label``: for each id of ``edges (a, b)`` the least id that it reaches. ``rows``: about how many ids there can be.

    Each task keeps a forest of its edges. Forests of at most ``one_task`` edges in all are joined in one task; rounds over
    so few rows would cost the driver far more, in jobs and plans, than they give. Larger ones go by rounds.

    Every round writes its labels into the shared folder, so no lineage grows, and deletes those before. Sums over
    neighbours start in the tasks that hold the edges, and the labels of hubs and of large classes go to where
    their rows are, so neither is a bottleneck. Rounds follow the logarithm of the longest path.
    """
    once = materialize(edges.select("a", "b").distinct(), "edges", rows)
    thin = materialize(once.mapInArrow(_forest, "a long, b long"), "edges", rows)
    discard(once)
    if thin.count() <= one_task:
        label = materialize(thin.coalesce(1).mapInArrow(_labels, "id long, label long"), "labels")
        discard(thin)
        release(edges.sparkSession)
        return label
    both = materialize(thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", rows)
    discard(thin)
    release(edges.sparkSession)
    # both directions are there: as many rows have an id as their a as have it as their b
    stars = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("n"))
    label = materialize(stars.withColumnRenamed("a", "id"), "labels", rows)
    number, ids = both.count(), label.count()
    while True:
        near = heavy_join(both, label.select(F.col("id").alias("b"), "label", "n"), ["b"], "n", number).groupBy("a").agg(F.min("label").alias("near"))
        least = materialize(label.join(near, label["id"] == near["a"]).select("id", "n", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels", rows)
        members = least.groupBy("label").agg(F.count("*").alias("of_label"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("further")).join(members, "label")
        new = heavy_join(least, jump, ["label"], "of_label", ids).select("id", "n", F.least("label", "further").alias("label"), "was")
        new = materialize(new, "labels", rows)
        discard(label, least)
        release(edges.sparkSession)
        if new.where("label != was").isEmpty():
            discard(both)
            return new.select("id", "label")
        label = new.select("id", "label", "n")
        label._written = new._written
