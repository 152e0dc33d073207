"""Approximate nearest neighbours by vantage-point trees, one per shard.

A node's vantage point splits its vectors at the median distance into an inner and an outer part, each
with the least and largest distance that occurs. The triangle inequality bounds the distance of a query to
a part from below. A part is left out if that bound times ``factor`` exceeds the k-th best distance so
far: factor 1 leaves out only what cannot matter and is exact; a larger factor leaves out more.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.metric import Best, in_order, lifted, search, valid

LEAF = 256
FACTOR = 3.0
SLACK = 1e-9


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes as arrays: vantage point, and per part its child node (or leaf, as -1 - number) and distance range."""
    points = lifted(vectors)
    rng = np.random.default_rng(len(ids))
    vantage, children, ranges = [], [], []
    order: list[np.ndarray] = []
    bounds = [0]

    def part(members: np.ndarray, owner: int, side: int, todo: list) -> int:
        if len(members) > leaf:
            todo.append((members, owner, side))
            return 0
        order.append(members)
        bounds.append(bounds[-1] + len(members))
        return -len(order)

    todo: list = []
    root = part(np.arange(len(ids)), -1, 0, todo)
    while todo:
        members, owner, side = todo.pop()
        number = len(vantage)
        if owner >= 0:
            children[owner][side] = number
        # of a few candidates, the one whose distances spread most
        sample = rng.choice(members, min(256, len(members)), replace=False)
        tries = rng.choice(members, min(8, len(members)), replace=False)
        far = [np.sqrt(((points[sample] - points[t]) ** 2).sum(1)).std() for t in tries]
        vp = int(tries[int(np.argmax(far))])
        d = np.sqrt(np.einsum("ij,ij->i", points[members] - points[vp], points[members] - points[vp]))
        by = np.argsort(d, kind="stable")
        half = len(members) // 2
        inner, outer = by[:half], by[half:]
        vantage.append(vp)
        children.append([0, 0])
        ranges.append([[d[inner].min(), d[inner].max()], [d[outer].min(), d[outer].max()]])
        for s, x in enumerate((inner, outer)):
            children[number][s] = part(members[x], number, s, todo)
    perm = np.concatenate(order) if order else np.zeros(0, np.int64)
    return {
        "ids": ids[perm], "vectors": vectors[perm], "bounds": np.array(bounds), "root": np.array(root), "vantage": points[vantage] if vantage else np.zeros((0, points.shape[1])),
        "children": np.array(children, np.int64).reshape(-1, 2), "ranges": np.array(ranges, float).reshape(-1, 2, 2), "most": np.array((points[:1] ** 2).sum()),
    }


def find(tree: dict[str, np.ndarray], query_id: int, query: np.ndarray, k: int, floor: float = -np.inf, factor: float = FACTOR, stats: dict | None = None) -> list[tuple[int, float]]:
    if not len(tree["ids"]):
        return []
    ids, vectors, bounds, children, ranges = (tree[x] for x in ("ids", "vectors", "bounds", "children", "ranges"))
    diff = tree["vantage"] - np.append(query, 0.0)
    to = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    # per node and part: how far a query at this distance is from the part at least
    low = np.maximum(np.maximum(ranges[:, :, 0] - to[:, None], to[:, None] - ranges[:, :, 1]), 0.0).tolist()
    kids = children.tolist()
    constant = float(query @ query) + float(tree["most"])
    slack = SLACK * max(1.0, constant)
    best, computed = Best(k, floor), 0
    reach = max(constant - 2 * floor, 0.0) ** 0.5 + slack if floor > -np.inf else np.inf
    queue = [(0.0, int(tree["root"]))]
    while queue:
        least, node = heapq.heappop(queue)
        if least * factor > reach:
            break
        if node < 0:
            a, b = bounds[-1 - node], bounds[-node]
            own, block = ids[a:b], vectors[a:b]
            computed += b - a
            if not (other := own != query_id).all():
                own, block = own[other], block[other]
            if not len(own):
                continue
            best.add(in_order(block, query, block @ query, best.worst, k), own)
            if best.worst > -np.inf:
                reach = max(constant - 2 * best.worst, 0.0) ** 0.5 + slack
            continue
        for s in (0, 1):
            if (b := max(least, low[node][s])) * factor <= reach:
                heapq.heappush(queue, (b, kids[node][s]))
    if stats is not None:
        stats["computed"] = stats.get("computed", 0) + computed
    return best.rows()


def neighbours(data: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """``query_id, rank, id, score``: the k rows of the largest inner product found for each query, its own id left out.

    Rows whose vector is null, empty, zero or has a null or non-finite component take no part, as data
    or as query. Rows that share an id never answer each other; repeated rows are so many answers; a repeated
    query is asked once; ties go to the smaller id. Further columns play no part; an empty table gives an empty one.
    """
    some = lambda df: valid(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    return search(some(data), some(queries), k, build, partial(find, factor=factor), factor)
