"""Removal of repeated word windows by a compacted de Bruijn graph.

Every window of ``k`` words is an edge of the graph between its first and its last ``k - 1`` words.
Consecutive windows of a document that share their minimizer (the least hashed run of ``ANCHOR`` words inside
the window) travel as one row, a piece (minimizer, hash of all its words), so a document of n words gives
about n/7 rows. Equal windows always meet under their minimizer. The steps, all joins and aggregations:

* *edges*: minimizers seen in several documents. Where all have the same piece, the piece stays whole; where
  pieces differ, the first source of each is read again and gives its single windows;
* *degrees*: nodes at the ends of repeated pieces are counted. One with a single way in and a single way out
  does not branch, and the pieces on its two sides become one *path* if they follow each other in their source;
* *sources*: each piece of a later document is joined to document, place and path of its first source;
* *verification*: pieces of one path that follow each other in both documents are one long span. The words of
  each different span are read again at its source and compared by a cryptographic digest; spans inside one row
  are compared word by word. If any span differs, all is done again with other hash functions.

Equal windows have equal hashes and every removed word lies in a verified span, so the result is that of
comparing all windows.
"""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.shared import discard, free_name, heavy_join, materialize, release, small_batches

WINDOW = 20
ANCHOR = 8
#: Bits of the filters sent to all tasks: 8 MB and 1 MB, whatever the size of the table. Where they are full, more rows are joined than needed.
PATH_BITS, DOC_BITS = 1 << 26, 1 << 23
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Spans of one source that are read again in one row; a source with more of them is read in several.
CLAIMS = 5_000
#: Bits of the hashes of pieces at each attempt; the last holds for all that follow.
WIDTHS = (64,)
ATTEMPTS = 8

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have)
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _bytes(seed: int) -> np.ndarray:
    """A random number for each byte."""
    return mix(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and the number of words of each text.

    Words are runs of other bytes than ASCII white space. A word's hash is a polynomial of random numbers
    for its bytes, from the difference of two running sums, so no word becomes an object.
    """
    coded = [(t or "").encode() for t in texts]
    text = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    limits = np.cumsum([len(c) + 1 for c in coded])
    n = len(text)
    space = _SPACE[text]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if n and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes(seed)[text] * _powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0)


class Block:
    """The paths of a few documents: per path the document's number, its first and last window, its minimizer and hash."""

    def __init__(self, texts: list[str | None], k: int = WINDOW, a: int = ANCHOR, seed: int = 0, bits: int = 64):
        self.k = k
        self.mask = np.uint64((1 << bits) - 1)
        w, sizes = word_hashes(texts, seed)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = len(w)
        self.path_doc = self.first = self.last = np.empty(0, np.int64)
        self.minimizer = self.hash = np.empty(0, np.uint64)
        if not (sizes >= k).any():
            return
        # sums of w[j] * base**j: a run's hash is a difference of two, taken back by base**-start
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(w * _powers(_BASE, n), out=self.sums[1:])
        least = mix(self._runs(np.arange(n - a + 1), a))
        value, place = least, np.arange(len(least), dtype=np.int32)
        span, want = 1, k - a + 1
        while span < want:
            step = min(span, want - span)
            left = value[:-step] <= value[step:]
            value = np.where(left, value[:-step], value[step:])
            place = np.where(left, place[:-step], place[step:])
            span += step
        starts = np.concatenate([np.arange(b, e - k + 1) for b, e in zip(self.begins, self.ends) if e - b >= k])
        doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - k + 1, 0))
        place = place[starts].astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(starts)) - 1
        self.path_doc, self.first, self.last = doc[heads], starts[heads], starts[tails]
        anchor = place[heads]
        self.minimizer = least[anchor]
        length = self.last - self.first + k
        shape = (length * 64 + (anchor - self.first)).astype(np.uint64)
        self.hash = mix((self.sums[self.first + length] - self.sums[self.first]) * _powers(_INVERSE, n)[self.first] + mix(shape)) & self.mask

    def _runs(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * _powers(_INVERSE, len(self.sums))[at]

    def windows(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the paths numbered: each window's path, start and hash."""
        count = self.last[paths] - self.first[paths] + 1
        path = np.repeat(paths, count)
        inside = np.arange(len(path)) - np.repeat(np.cumsum(count) - count, count)
        start = self.first[path] + inside
        return path, start, mix(self._runs(start, self.k) ^ self.minimizer[path]) & self.mask

    def node(self, start: np.ndarray) -> np.ndarray:
        """Hashes of the nodes, ``k - 1`` words each, that begin at the words ``start``."""
        return mix(self._runs(start, self.k - 1))

    @property
    def counts(self) -> np.ndarray:
        """Windows of each path."""
        return self.last - self.first + 1


#: What an item of a list counts in :func:`blocks`: about the bytes of a number, or of a claim, as Python objects.
ITEM, CLAIM = 40, 480


def _weights(batch, columns: tuple[str, ...]) -> np.ndarray:
    """About how many bytes each row's texts and lists take as Python objects."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in map(batch.column, columns):
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            each = CLAIM if pa.types.is_struct(c.type.value_type) else ITEM
            total += each * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total


def blocks(batches, *columns: str, at_once: int = 700_000):
    """Rows of the batches in runs of about ``at_once`` bytes, lists included: a list for each column, the first holding the texts.

    Only the rows of a run are Python objects at a time, and memory goes back to the system after each batch.
    """
    for batch in batches:
        upto = np.cumsum(_weights(batch, columns))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, side="right")))
            yield [batch.column(c).slice(at, end - at).to_pylist() for c in columns]
            at = end
        give_back()


def give_back() -> None:
    """Freed memory of the allocators back to the system; workers live long and share a limit with their executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not the GNU C library
    _trim = None


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sieve(df: DataFrame, slot, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with those of the column ``slot`` set, put together from pieces of 4 KB."""
    place = slot + 1  # numbering of the bitmap functions starts at 1
    rows = (
        df.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("at"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bitmap")).collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["at"] - 1) * 4096 :][:4096] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def _hits(sieve: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (sieve[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _doc_slot():
    return F.pmod(F.xxhash64("id"), F.lit(DOC_BITS))


def _coded(df: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """``text, id, t``: ``t``, a hash of the text, tells rows of one id apart."""
    text = F.col(f"`{text_col}`")
    return df.select(text.alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text, F.lit(seed)).alias("t"))


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be one of ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(ids, _doc_slot(), DOC_BITS))

    @F.arrow_udf("boolean")
    def maybe(slots: pa.Array) -> pa.Array:
        return pa.array(_hits(shared.value, slots.to_numpy(zero_copy_only=False)))

    return docs.where(maybe(_doc_slot()))


#: Kinds of pieces: the only one of its minimizer, a window at a branch, one of several of its minimizer.
WHOLE, EDGE, BRANCH = range(3)
_EDGES = "id long, t long, start long, size long, kind int, m long, h long, before long, after long"


def _paths(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``path``: where, in the source, the nonbranching path begins to which the piece belongs."""
    graph = pieces.where(F.col("kind") != BRANCH)
    none, end = F.lit(None).cast("long"), F.xxhash64("id", "t", F.col("start") + F.col("size"))
    graph = graph.withColumn("place", F.xxhash64("id", "t", "start"))
    ends = graph.select(F.col("before").alias("node"), F.col("place").alias("out"), none.alias("into")).unionByName(
        graph.select(F.col("after").alias("node"), none.alias("out"), end.alias("into"))
    )
    joints = (
        ends.groupBy("node").agg(F.count("into").alias("ways_in"), F.count("out").alias("ways_out"), F.max("into").alias("into"), F.max("out").alias("place"))
        .where("ways_in = 1 and ways_out = 1 and into = place").select("place", F.lit(True).alias("joined"))
    )
    along = Window.partitionBy("id", "t").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)  # the pieces of one text
    head = F.when(F.col("joined").isNull(), F.col("start"))
    graph = graph.join(joints, "place", "left").withColumn("path", F.last(head, ignorenulls=True).over(along)).drop("joined", "place")
    return graph.unionByName(pieces.where(F.col("kind") == BRANCH).withColumn("path", F.col("start")))


def repeated_windows(docs: DataFrame, k: int = WINDOW, seed: int = 0, bits: int = 64) -> DataFrame:
    """``id, paths, windows``: what of each row of ``docs`` (``text, id, t``) starts in a smaller id.

    Both are lists of five numbers each: hash of the piece, then id, ``t``, place and path of its first source.
    """

    def rows(batches, sieve=None):
        for texts, ids in blocks(batches, "text", "id"):
            b = Block(texts, k, seed=seed, bits=bits)
            doc, m, h = b.path_doc, b.minimizer, b.hash
            if not len(doc):
                continue
            if sieve is not None:
                may = _hits(sieve.value, (m & np.uint64(PATH_BITS - 1)).astype(np.int64))
                doc, m, h = doc[may], m[may], h[may]
            # a path counts once a document
            key = mix(h + mix(m + mix(doc.astype(np.uint64))))
            _, once = np.unique(key, return_index=True)
            ids_of = np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids_of[doc[once]]), _signed(m[once]), _signed(h[once])], ["id", "m", "h"])

    # minimizers of several documents; one that all have in the same path has least == most
    met = (
        docs.select("text", "id").mapInArrow(rows, "id long, m long, h long")
        .groupBy("m").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("m", "first", "least", (F.col("least") == F.col("most")).alias("single"), "n")
    )
    met = materialize(met, "minimizers")
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(met, F.col("m").bitwiseAND(F.lit(PATH_BITS - 1)), PATH_BITS))
    again = docs.select("text", "id").mapInArrow(lambda batches: rows(batches, shared), "id long, m long, h long")
    seen = materialize(heavy_join(again, met.drop("least"), ["m"], "n").where("not single or id > first"), "paths")
    branch = seen.where("not single").select("id", "m", "h")
    firsts = materialize(branch.groupBy("m", "h").agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts", met.count())

    # pieces where they come first, and windows of those at a branch
    todo = met.where("single").select(F.col("first").alias("id"), F.col("least").alias("whole"), F.lit(None).cast("long").alias("branch"))
    todo = todo.unionByName(firsts.select(F.col("first").alias("id"), F.lit(None).cast("long").alias("whole"), F.col("h").alias("branch")))
    todo = materialize(todo.groupBy("id").agg(F.collect_list("whole").alias("wholes"), F.collect_list("branch").alias("branches")), "sources")

    def expand(batches):
        for texts, ids, ts, wholes, branches in blocks(batches, "text", "id", "t", "wholes", "branches"):
            b = Block(texts, k, seed=seed, bits=bits)
            if not len(b.hash):
                continue
            mine = mix(b.hash + mix(b.path_doc.astype(np.uint64)))
            ids_of, ts_of = np.array(ids, np.int64), np.array(ts, np.int64)
            at_branch = np.flatnonzero(np.isin(mine, _keys(branches)))
            window = b.windows(at_branch)
            for kind, path, start, h in (
                (WHOLE, p := np.flatnonzero(np.isin(mine, _keys(wholes))), b.first[p], b.hash[p]),
                (BRANCH, at_branch, b.first[at_branch], b.hash[at_branch]),
                (EDGE, *window),
            ):
                key = mix(h + mix(b.minimizer[path] + mix(b.path_doc[path].astype(np.uint64))))
                _, once = np.unique(key, return_index=True)
                path, start, h = path[once], start[once], h[once]
                size = b.counts[path] if kind != EDGE else np.ones(len(path), np.int64)
                doc = b.path_doc[path]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_of[doc]), pa.array(ts_of[doc]), pa.array(start - b.begins[doc]), pa.array(size), pa.array(np.full(len(path), kind, np.int32)),
                     _signed(b.minimizer[path]), _signed(h), _signed(b.node(start)), _signed(b.node(start + size))],
                    ["id", "t", "start", "size", "kind", "m", "h", "before", "after"],
                )

    edges = materialize(_among(docs, todo).join(todo, "id").select("text", "id", "t", "wholes", "branches").mapInArrow(expand, _EDGES), "edges")
    discard(todo)
    release(docs.sparkSession)
    place = ("id", "t", "start", "size", "before", "after")
    pieces = edges.groupBy("kind", "m", "h").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n"))
    pieces = pieces.where((F.col("kind") != EDGE) | (F.col("n") > 1)).select("kind", "m", "h", "n", "first.*")
    pieces = materialize(_paths(pieces), "pieces")

    # later documents' pieces with their sources
    source = [F.col("id").alias("first"), F.col("t").alias("ft"), F.col("start").alias("fs"), "path"]
    of = {kind: pieces.where(F.col("kind") == kind).select("m", "h", *source, "n") for kind in (WHOLE, EDGE, BRANCH)}
    whole = heavy_join(seen.where("single").select("id", "m", "h"), of[WHOLE].drop("n").join(met.select("m", "n"), "m"), ["m", "h"], "n")
    several = heavy_join(branch, of[BRANCH].drop("n").join(firsts.select("m", "h", "n"), ["m", "h"]), ["m", "h"], "n")
    edge = heavy_join(edges.where(F.col("kind") == EDGE).select("id", "m", "h"), of[EDGE], ["m", "h"], "n")
    five = F.array("h", "first", "ft", "fs", "path")
    found = (
        whole.unionByName(several).withColumn("windows", F.lit(False)).unionByName(edge.withColumn("windows", F.lit(True)))
        .where("id > first").groupBy("id")
        .agg(F.flatten(F.collect_list(F.when(~F.col("windows"), five))).alias("paths"), F.flatten(F.collect_list(F.when(F.col("windows"), five))).alias("windows"))
    )
    found = materialize(found, "repeats")
    discard(met, seen, firsts, edges, pieces)
    return found


_CUT = (
    "struct<n_words: bigint, n_removed: bigint, kept: string, spans: array<struct<start: bigint, length: bigint>>, "
    "sound: boolean, claims: array<struct<id: bigint, t: bigint, start: bigint, length: bigint, digest: binary>>>"
)
_CUT_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ("sound", pa.bool_()), ("claims", pa.list_(pa.struct([("id", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("digest", pa.binary())]))),
])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``df`` with ``n_words, n_removed, kept`` (words joined by one space) and ``spans array<struct<start, length>>`` of words removed.

    A window of ``k`` words repeats if the same words start in a smaller id or earlier in the same row.
    A null text has no words and an empty ``kept``; null ids are the smallest; rows of one id are judged
    against smaller ids and themselves, not against each other; an empty table gives an empty one. Columns of
    the input with the names of the four new ones are replaced; all others stay, whatever their names.
    The result is a table in the shared folder whose spans are all verified at their sources; ``ArithmeticError``
    tells that ``ATTEMPTS`` families of hashes (of ``widths`` bits) in a row had collisions.
    """
    small_batches(df.sparkSession)
    made = ("n_words", "n_removed", "kept", "spans")
    key, paths, windows, result, sound, claims = (free_name(df, c) for c in ("key", "paths", "windows", "cut", "sound", "claims"))
    for seed in range(ATTEMPTS):
        bits = widths[min(seed, len(widths) - 1)]
        docs = _coded(df, id_col, text_col, seed)
        found = repeated_windows(docs, k, seed, bits)
        release(df.sparkSession)
        lists = found.select(F.col("id").alias(key), F.col("paths").alias(paths), F.col("windows").alias(windows))
        joined = df.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))).join(lists, key, "left")
        joined = joined.withColumn(result, _cutter(k, seed, bits)(F.col(f"`{text_col}`"), F.col(paths), F.col(windows)))
        others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
        cut = joined.select(*others, *[F.col(f"{result}.{c}") for c in made], F.col(f"{result}.sound").alias(sound), F.col(f"{result}.claims").alias(claims))
        cut = materialize(cut, "cut", compression="zstd")
        discard(found)
        release(df.sparkSession)
        if cut.where(~F.col(sound)).isEmpty() and not _differing(docs, cut.select(F.explode(claims).alias("c")).select("c.*")):
            return cut.drop(sound, claims)
        discard(cut)
    raise ArithmeticError(f"{ATTEMPTS} families of hashes had collisions")


def _differing(docs: DataFrame, claims: DataFrame) -> int:
    """How many different spans do not have their words at their source."""
    claims = materialize(claims.distinct(), "claims")
    sizes = claims.groupBy("id", "t").agg(F.ceil(F.count("*") / CLAIMS).alias("parts"))
    part = F.pmod(F.xxhash64("start", "length"), F.col("parts"))
    lists = claims.join(sizes, ["id", "t"]).groupBy("id", "t", part.alias("part")).agg(F.collect_list(F.struct("start", "length", "digest")).alias("claims"))

    def compare(batches):
        for texts, asked in blocks(batches, "text", "claims"):
            bad = 0
            for text, spans in zip(texts, asked):
                words = (text or "").encode().split()
                bad += sum(_digest(words, c["start"], c["length"]) != c["digest"] for c in spans)
            yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int64())], ["bad"])

    checked = _among(docs, claims).join(lists, ["id", "t"]).select("text", "claims").mapInArrow(compare, "bad long")
    bad = checked.agg(F.sum("bad")).first()[0] or 0
    discard(claims)
    return bad


def _digest(words: list[bytes], start: int, length: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + length]), digest_size=16).digest()


def _cutter(k: int, seed: int, bits: int):
    @F.arrow_udf(_CUT)
    def cut(texts: pa.Array, paths: pa.Array, windows: pa.Array) -> pa.Array:
        out = []
        batch = pa.RecordBatch.from_arrays([texts, paths, windows], ["t", "p", "w"])
        for part in blocks([batch], "t", "p", "w"):
            out += _cut_block(*part, k, seed, bits)
        return pa.array(out, _CUT_ARROW)

    return cut


def _listed(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys (hash and row) in order, with the sources that belong to them, of lists of five numbers each."""
    parts = [(d, np.array(x, np.int64).reshape(-1, 5)) for d, x in enumerate(lists) if x]
    if not parts:
        return np.empty(0, np.uint64), np.empty((0, 4), np.int64)
    keys = np.concatenate([mix(x[:, 0].astype(np.uint64) + mix(np.full(len(x), d, np.uint64))) for d, x in parts])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([x[:, 1:] for _, x in parts])[order]


def _sources(keys: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are listed, and the place of each in the list."""
    have, _ = listed
    if not len(have):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return have[at] == keys, at


def _earlier(keys: np.ndarray) -> np.ndarray:
    """For each key the place of the first equal one."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first[back]


class _Claims:
    """Repeated pieces of a block: place, windows, and the source's id, hash, place and path."""

    def __init__(self):
        self.rows: list[np.ndarray] = []

    def add(self, own: bool, start, size, sid, t, at, path) -> None:
        n = len(start)
        self.rows.append(np.stack([np.full(n, own), start, size, *(np.broadcast_to(x, n) for x in (sid, t, at, path))], axis=1).astype(np.int64))

    def merged(self) -> np.ndarray:
        """Pieces of one path that follow each other here and at the source are one row."""
        rows = np.concatenate(self.rows)
        if not len(rows):
            return rows
        own, start, size, sid, t, at, path = rows[np.lexsort((rows[:, 1], rows[:, 0]))].T
        new = np.ones(len(start), bool)
        same = [x[1:] == x[:-1] for x in (own, sid, t, path, at - start)] + [start[1:] == start[:-1] + size[:-1]]
        new[1:] = ~np.logical_and.reduce(same)
        heads = np.flatnonzero(new)
        return np.stack([own[heads], start[heads], np.add.reduceat(size, heads), sid[heads], t[heads], at[heads]], axis=1)


def _cut_block(texts: list, paths: list, windows: list, k: int, seed: int = 0, bits: int = 64) -> list[dict]:
    b = Block(texts, k, seed=seed, bits=bits)
    drop = np.zeros(int(b.ends[-1]) + 1 if len(b.ends) else 1, np.int64)
    claims = np.empty((0, 6), np.int64)
    if len(b.hash):
        found = _Claims()
        doc64 = mix(b.path_doc.astype(np.uint64))
        # paths that start earlier in the row or in a smaller id
        earlier = _earlier(mix(b.hash + mix(b.minimizer + doc64)))
        own = earlier < np.arange(len(earlier))
        listed = _listed(paths)
        other, at = _sources(mix(b.hash + doc64), listed)
        gone = own | other
        p = np.flatnonzero(own)
        found.add(True, b.first[p], b.counts[p], b.path_doc[p], 0, b.first[earlier[p]], 0)
        p = np.flatnonzero(other & ~own)
        found.add(False, b.first[p], b.counts[p], *listed[1][at[p]].T)
        # windows, where a minimizer comes again in the row or the list names some
        by_m = mix(b.minimizer + doc64)
        _, back, count = np.unique(by_m, return_inverse=True, return_counts=True)
        named = np.array([bool(w) for w in windows])
        look = np.flatnonzero((count[back] > 1) | (named[b.path_doc] & ~gone))
        path, start, wh = b.windows(look)
        wdoc = doc64[path]
        earlier = _earlier(mix(wh + mix(b.minimizer[path] + wdoc)))
        inside = (earlier < np.arange(len(earlier))) & ~gone[path]
        listed = _listed(windows)
        other, at = _sources(mix(wh + wdoc), listed)
        other &= ~gone[path] & ~inside
        ones = np.ones(len(start), np.int64)
        found.add(True, start[inside], ones[inside], b.path_doc[path[inside]], 0, start[earlier[inside]], 0)
        found.add(False, start[other], ones[other], *listed[1][at[other]].T)
        claims = found.merged()
        # every claim is a run of windows to go
        np.add.at(drop, claims[:, 1], 1)
        np.subtract.at(drop, claims[:, 1] + claims[:, 2] + k - 1, 1)
    dropped = np.cumsum(drop[:-1]) > 0
    of = np.searchsorted(b.ends, claims[:, 1], side="right")
    order = np.argsort(of, kind="stable")
    limits = np.searchsorted(of[order], np.arange(len(texts) + 1))
    out = []
    for d, (text, begin, end) in enumerate(zip(texts, b.begins, b.ends)):
        words = (text or "").encode().split()
        mask = dropped[begin:end]
        sound, asked = True, []
        if mask.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
            kept = [w for w, gone in zip(words, mask.tolist()) if not gone]
            for own, start, size, sid, t, at in claims[order[limits[d] : limits[d + 1]]].tolist():
                start, length = start - int(begin), size + k - 1
                if own:
                    at -= int(begin)
                    sound &= words[start : start + length] == words[at : at + length]
                else:
                    asked.append({"id": sid, "t": t, "start": at, "length": length, "digest": _digest(words, start, length)})
        else:
            spans, kept = [], words
        out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode(), "spans": spans, "sound": sound, "claims": asked})
    return out


def _keys(lists: list) -> np.ndarray:
    parts = [mix(np.array(x, np.int64).view(np.uint64) + mix(np.full(len(x), d, np.uint64))) for d, x in enumerate(lists) if x]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)
