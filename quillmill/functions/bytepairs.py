"""Byte-pair token counts by the merge ranks of a vocabulary file.

A text is cut into pieces by a pattern; the bytes of a piece are joined pair by pair, the pair of the lowest rank
first and of equal ranks the leftmost. The pairs at hand wait in a heap, so a piece of n bytes takes n log n steps.
"""

from __future__ import annotations

import base64
import heapq

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: where byte-level vocabularies of this kind cut a text before merging.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairs:
    """``pairs(text)`` counts the tokens of a text, ``encode(text)`` gives their ids.

    The file has a line for each token: its bytes in base64 and its rank, which is its id. The counts of at most
    ``cache_size`` short pieces are kept. An empty text has no tokens. Pickled by its path; see ``byte_pairs``.
    """

    #: Of characters; longer pieces are counted each time.
    KEPT = 64

    def __init__(self, path: str, cuts: str = CUTS, cache_size: int = 300_000):
        self.path, self.cuts, self.cache_size = path, cuts, cache_size
        self.pattern = regex.compile(cuts)
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.counts: dict[str, int] = {}

    def __reduce__(self):
        return byte_pairs, (self.path, self.cuts)

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a piece."""
        if data in self.ranks:
            return [data]
        rank, n = self.ranks.get, len(data)
        stop = list(range(1, n + 1))  # of the part that starts here; 0 where none does
        before = list(range(-1, n))  # start of the part in front of the one that starts here
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, middle, b = heapq.heappop(heap)
            if stop[a] != middle or stop[middle] != b:
                continue  # one of the two has been joined to something else
            stop[a], stop[middle] = b, 0
            if b < n:
                before[b] = a
                if (r := rank(data[a : stop[b]])) is not None:
                    heapq.heappush(heap, (r, a, b, stop[b]))
            if (left := before[a]) >= 0 and (r := rank(data[left:b])) is not None:
                heapq.heappush(heap, (r, left, a, b))
        out, at = [], 0
        while at < n:
            out.append(data[at : stop[at]])
            at = stop[at]
        return out

    def weigh(self, piece: str) -> int:
        """Tokens of one piece."""
        n = self.counts.get(piece)
        if n is None:
            n = len(self.merged(piece.encode()))
            if len(piece) <= self.KEPT:
                if len(self.counts) >= self.cache_size:
                    self.counts.clear()
                self.counts[piece] = n
        return n

    def __call__(self, text: str) -> int:
        return sum(map(self.weigh, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return [self.ranks[t] for piece in self.pattern.findall(text) for t in self.merged(piece.encode())]


_LOADED: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, cuts: str = CUTS) -> BytePairs:
    """One per process and file; every executor sees the file under this path."""
    if (path, cuts) not in _LOADED:
        _LOADED[path, cuts] = BytePairs(path, cuts)
    return _LOADED[path, cuts]


def token_count(text: Column, path: str) -> Column:
    """Byte-pair tokens of whole texts; null for null."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        count = byte_pairs(path)
        return pa.array([None if t is None else count(t) for t in texts.to_pylist()], pa.int64())

    return run(text)
