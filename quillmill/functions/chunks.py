"""Chunks of a text by a list of separators, within a number of tokens and with an overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.bytepairs import BytePairs

#: Size and overlap in tokens by document type; any other type is treated as private.
CONFIG = {"caselaw": (512, 64), "published": (512, 64), "private": (2048, 128), "uncertain": (2048, 128)}
#: Separators of opinions, then of all texts.
COMMON_SEPARATORS = ["\n\n", "\n", " ", ""]
LEGAL_SEPARATORS = [
    "\n\nI.", "\n\nII.", "\n\nIII.", "\n\nIV.", "\n\nV.", "\n\nA.", "\n\nB.", "\n\nC.", "\n\nFACTS", "\n\nANALYSIS", "\n\nHELD",
    "\n\nHOLDING", "\n\nCONCLUSION", "\n\nDISCUSSION", "\n\nBACKGROUND", *COMMON_SEPARATORS,
]
#: The default tokenizer, named in every result that counts with it: runs of letters and digits, and other visible characters.
TOKEN_PATTERN = r"\w+|[^\w\s]"
_TOKEN = re.compile(TOKEN_PATTERN)
TYPE = "array<struct<text:string,index:int,total:int,token_count:int>>"


def word_tokens(text: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(text))


def token_count(text: Column) -> Column:
    """The default count inside the JVM."""
    return F.regexp_count(text, F.lit(f"(?U){TOKEN_PATTERN}"))


class PrefixSums:
    """Tokens in any part of a text, from one pass over it.

    The tokens of ``text[a:b]`` are those of the whole text but near its ends: from ``a`` on they are matched anew until a token
    ends where one of the whole text does or between two, and so are those that end less than two characters before
    ``b``, as what stands behind ``b`` may have decided them. In between the sums tell. ``weigh``: what a match counts, one by default.
    The pattern must not look back, nor ahead by more than a character.
    """

    def __init__(self, text: str, pattern, weigh: Callable[[str], int] | None = None):
        self.text, self.pattern, self.weigh = text, pattern, weigh
        found = [m.span() for m in pattern.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self.sums = list(accumulate((weigh(text[a:b]) for a, b in found), initial=0)) if weigh else range(len(found) + 1)

    def between(self, a: int, b: int) -> int:
        n, known, i = 0, bisect_right(self.ends, b - 2), bisect_right(self.ends, a)
        while i < known and self.starts[i] < a:
            m = self.pattern.search(self.text, a, b)
            n += self.weigh(m.group()) if self.weigh else 1
            a = m.end()
            i = bisect_right(self.ends, a)
        if i < known:
            n += self.sums[known] - self.sums[i]
            a = self.ends[known - 1]
        for m in self.pattern.finditer(self.text, a, b):
            n += self.weigh(m.group()) if self.weigh else 1
        return n


class Whole:
    """As ``PrefixSums`` for a tokenizer of which nothing is known."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.text, self.count = text, count

    def between(self, a: int, b: int) -> int:
        return self.count(self.text[a:b])


def sums(text: str, count: Callable[[str], int]) -> PrefixSums | Whole:
    if count is word_tokens:
        return PrefixSums(text, _TOKEN)
    if isinstance(count, BytePairs):
        return PrefixSums(text, count.pattern, count.weigh)
    return Whole(text, count)


class Splitter:
    """Cuts at the first separator of the list that occurs, each piece starting with its separator; pieces
    that are too large are cut by the separators behind it, and small neighbours are joined up to ``size``,
    the next chunk starting with as many of the last pieces as fit into ``overlap``.

    Pieces and chunks are places in the text. A piece counts by itself, whatever tokens would cross its border."""

    def __init__(self, size: int, overlap: int, separators: list[str], count: Callable[[str], int] = word_tokens):
        self.size, self.overlap, self.separators, self.count = size, overlap, separators, count

    def split(self, text: str) -> list[str]:
        return [text[a:b] for a, b, _ in self.places(text)]

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """Start, end and tokens of each chunk; none where the text is blank."""
        known = sums(text, self.count)
        out = []
        for a, b in self._split(text, known, 0, len(text), 0):
            a += len(text[a:b]) - len(text[a:b].lstrip())
            b = a + len(text[a:b].rstrip())
            if a < b:
                out.append((a, b, known.between(a, b)))
        return out

    def _split(self, text: str, known, a: int, b: int, level: int) -> list[tuple[int, int]]:
        """At most as deep as there are separators."""
        use = next((k for k in range(level, len(self.separators)) if text.find(self.separators[k], a, b) >= 0), None)
        if use is None:
            return [(a, b)]
        out: list[tuple[int, int]] = []
        small: list[int] = []  # borders of pieces that follow each other
        prefix = [0]
        borders = self._cut(text, self.separators[use], a, b)
        for start, end in zip(borders, borders[1:]):
            n = known.between(start, end)
            if n < self.size:
                small.append(start)
                prefix.append(prefix[-1] + n)
            else:
                out += self._join([*small, start], prefix) + self._split(text, known, start, end, use + 1)
                small, prefix = [], [0]
        return out + self._join([*small, b], prefix)

    @staticmethod
    def _cut(text: str, separator: str, a: int, b: int) -> list[int]:
        """Borders of the pieces, both ends included."""
        if not separator:
            return list(range(a, b + 1))
        out, at = [a], text.find(separator, a, b)
        while at >= 0:
            if at > a:
                out.append(at)
            at = text.find(separator, at + len(separator), b)
        return [*out, b]

    def _join(self, borders: list[int], prefix: list[int]) -> list[tuple[int, int]]:
        """Chunks of pieces between ``borders``, whose counts add up to ``prefix``: from border to border by binary search."""
        chunks, first, last = [], 0, len(borders) - 1
        while last:
            end = bisect_right(prefix, prefix[first] + self.size) - 1
            chunks.append((borders[first], borders[end]))
            if end == last:
                break
            first = bisect_left(prefix, max(prefix[end] - self.overlap, prefix[end + 1] - self.size), first, end)
        return chunks


def chunked(text: Column, doc_type: Column, count: Callable[[str], int] = word_tokens) -> Column:
    """``array<struct<text, index, total, token_count>>``; a text without a piece is one chunk as it is.

    The splitter's state runs through a text, so this is an Arrow function; ``count`` is the tokenizer.
    """

    @F.arrow_udf(TYPE)
    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for text, kind in zip(texts.to_pylist(), kinds.to_pylist()):
            if text is None:
                out.append(None)
                continue
            size, overlap = CONFIG.get(kind, CONFIG["private"])
            separators = LEGAL_SEPARATORS if kind == "caselaw" else COMMON_SEPARATORS
            parts = Splitter(size, overlap, separators, count).places(text) or [(0, len(text), count(text))]
            out.append([{"text": text[a:b], "index": i, "total": len(parts), "token_count": n} for i, (a, b, n) in enumerate(parts)])
        item = pa.struct([("text", pa.string()), ("index", pa.int32()), ("total", pa.int32()), ("token_count", pa.int32())])
        return pa.array(out, pa.list_(item))

    return run(text, doc_type)
