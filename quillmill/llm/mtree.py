"""Exact top-k by an M-tree with best-first search.

Inner pages hold routing objects with the covering radius of what lies below and the distance to the
parent's routing object; leaf pages hold vectors with their distance to the leaf's routing object. A page
is opened in the order of the least possible distance. Before any distance to an entry is computed, the
stored parent distance bounds it by the triangle inequality; only entries that the bound cannot rule out
are computed.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.metric import Best, in_order, lifted, search, valid

PAGE = 256
SLACK = 1e-7


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    diff = points - to
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def build(ids: np.ndarray, vectors: np.ndarray, page: int = PAGE) -> dict[str, np.ndarray]:
    """Bulk load: a set larger than a page is dealt to routing objects, each entry to the nearest; the rest is recursion without a stack."""
    points = lifted(vectors)
    rng = np.random.default_rng(len(ids))
    #: per page: first entry, number of entries, whether its entries are vectors, the point of its routing object
    pages: list[list] = []
    entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # object, radius, parent distance
    child: list[np.ndarray] = []
    todo = [(np.arange(len(ids)), 0 if len(ids) else -1, -1, -1)]
    while todo:
        members, pivot, owner, slot = todo.pop()
        number = len(pages)
        if owner >= 0:
            child[owner][slot] = number
        if len(members) <= page:
            pages.append([True, pivot])
            entries.append((members, np.zeros(len(members)), _distances(points[members], points[pivot]) if len(members) else np.zeros(0)))
            child.append(np.full(len(members), -1))
            continue
        routes = np.sort(rng.choice(members, min(page, -(-len(members) // page) * 2), replace=False))
        spread = np.stack([_distances(points[members], points[r]) for r in routes])
        nearest = spread.argmin(0)
        if (np.bincount(nearest, minlength=len(routes)) == len(members)).any():
            nearest = np.arange(len(members)) % len(routes)  # nothing but equal points
        radius, kept = [], []
        for k in range(len(routes)):
            own = nearest == k
            if own.any():
                kept.append(k)
                radius.append(spread[k][own].max())
        pages.append([False, pivot])
        entries.append((routes[kept], np.array(radius), _distances(points[routes[kept]], points[pivot])))
        child.append(np.full(len(kept), -1))
        todo += [(members[nearest == k], routes[k], number, at) for at, k in enumerate(kept)]
    # vectors lie in the order of the leaf pages, so a page is one slice
    perm = np.concatenate([e[0] for p, e in zip(pages, entries) if p[0]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    start = np.zeros(len(pages), np.int64)
    at = 0
    for number, (p, e) in enumerate(zip(pages, entries)):
        if p[0]:
            start[number], at = at, at + len(e[0])
    sizes = [len(e[0]) for e in entries]
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return {
        "ids": ids[perm], "vectors": vectors[perm], "points": points, "start": start,
        "first": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), "leaf": np.array([p[0] for p in pages]), "pivot": np.array([p[1] for p in pages]),
        "object": join([e[0] for e in entries], np.int64), "radius": join([e[1] for e in entries], float), "back": join([e[2] for e in entries], float),
        "child": join(child, np.int64), "most": np.array((points[:1] ** 2).sum()),
    }


def find(tree: dict[str, np.ndarray], query_id: int, query: np.ndarray, k: int, floor: float = -np.inf, stats: dict | None = None, exact=None) -> list[tuple[int, float]]:
    """The k best (id, inner product) of a tree but for ``query_id`` itself, of those that reach ``floor``.

    Products of whole numbers are exact in any order of addition; for others ``exact`` corrects scores that may count.
    """
    best = Best(k, floor)
    if not len(tree["ids"]):
        return []
    ids, vectors, points = tree["ids"], tree["vectors"], tree["points"]
    first, leaf, pivot, obj, radius, back, child, start = (tree[x] for x in ("first", "leaf", "pivot", "object", "radius", "back", "child", "start"))
    target = np.append(query, 0.0)
    # |q' - v'|^2 = |q|^2 + M - 2 q.v
    constant = float(query @ query) + float(tree["most"])
    slack = SLACK * max(1.0, constant**0.5)
    reach = max(constant - 2 * floor, 0.0) ** 0.5 + slack if floor > -np.inf else np.inf

    def distance(at: int) -> float:
        d = points[at] - target
        return float(d @ d) ** 0.5

    computed = 1
    queue = [(0.0, 0, distance(pivot[0]))]
    while queue:
        low, page, here = heapq.heappop(queue)
        if low > reach:
            break
        a, b = first[page], first[page + 1]
        bound = np.abs(here - back[a:b])
        if leaf[page]:
            own, block = ids[start[page] : start[page] + b - a], vectors[start[page] : start[page] + b - a]
            near = bound <= reach
            near &= own != query_id
            count = int(near.sum())
            computed += count
            if not count:
                continue
            if 2 * count < b - a:
                own, scores = own[near], block[near] @ query
            else:  # a slice as it lies is quicker than picking most of its rows
                scores = block @ query
                if count < b - a:
                    own, scores = own[near], scores[near]
            if exact is not None:
                scores = exact(block if count == b - a else block[near], query, scores, best.worst, k)
            best.add(scores, own)
            if best.worst > -np.inf:
                reach = max(constant - 2 * best.worst, 0.0) ** 0.5 + slack
            continue
        keep = np.flatnonzero(bound - radius[a:b] <= reach)
        at = obj[a:b][keep]
        computed += len(at)
        d = _distances(points[at], target)
        lows = np.maximum(d - radius[a:b][keep], low)
        for lo, c, x in zip(lows.tolist(), child[a:b][keep].tolist(), d.tolist()):
            if lo <= reach:
                heapq.heappush(queue, (lo, c, x))
    if stats is not None:
        stats["computed"] = stats.get("computed", 0) + computed
    return best.rows()


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float | None = 256.0) -> DataFrame:
    """``query_id, rank, id, score``: the k largest inner products of each query with all rows but its own, exactly.

    With ``scale`` each component x counts as floor(scale * x), and scores are whole numbers (exact up to
    2**53). Rows whose vector is null, empty or has a null or non-finite component take no part, as data
    or as query. Rows that share an id never answer each other; repeated rows are so many answers; a repeated
    query is asked once; ties go to the smaller id. Further columns play no part; an empty table gives an empty one.
    """
    whole = (lambda df: df.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))) if scale else (lambda df: df)
    answer = find if scale else partial(find, exact=in_order)
    return search(whole(valid(data, id_col, vector_col)), whole(valid(queries, id_col, vector_col)), k, build, answer)
