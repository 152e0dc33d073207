"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are dealt by a seeded hash of their ids, texts and places to groups of a bounded number of characters, so
repeated rows spread too; each group packs alone, so no task holds more than one group and nothing is exchanged between groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.shared import small_batches
from quillmill.llm.substrings import give_back
from quillmill.llm.tokens import tokenizer

GROUP_BYTES = 2_000_000  # of text in a group, on average
ROW_BYTES = 32  # that a row counts besides its text, so rows without text fill groups too
SEQUENCE = 1024


class TournamentTree:
    """Free room of bins in order of opening; the first bin with enough room in O(log bins)."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def take(self, need: int) -> int:
        """Index of the first bin with ``need`` free, whose room then shrinks by it."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        best[at] -= need
        bin_, at = at - self.leaves, at >> 1
        while at:
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if left >= right else right
            at >>= 1
        return bin_


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item indices; every size is in 1..room. Ties keep the order given."""
    tree = TournamentTree(len(sizes), room)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.take(sizes[i])
        while b >= len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_lengths(lengths: list[int], room: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every id of every document once.

    Whole multiples of ``room`` fill sequences of their own. The rests are packed first-fit
    decreasing; then the emptiest bins are cut up to fill the gaps of the fullest, and what is left
    at the very end goes to sequences whose lengths are powers of two, which need no padding.
    """
    sequences = []
    rests: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        full = n - n % room
        sequences += [[(d, s, room)] for s in range(0, full, room)]
        if n > full:
            rests.append((d, full, n - full))
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], room)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        taker, donor = order[lo], order[hi]
        gap = room - fill[taker]
        if not gap:
            lo += 1
        elif not bins[donor]:
            hi -= 1
        else:
            d, s, n = bins[donor].pop()
            move = min(gap, n)
            bins[taker].append((d, s + n - move, move))
            fill[taker] += move
            fill[donor] -= move
            if n > move:
                bins[donor].append((d, s, n - move))
    for b in range(len(bins)):
        if fill[b] == room:
            sequences.append(bins[b])
        elif bins[b]:
            sequences += _powers_of_two(bins[b], fill[b])
    return sequences


def _powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need, now = total & (1 << bit), []
        while need:
            d, s, n = left.pop()
            if n > need:
                left.append((d, s + need, n - need))
                n = need
            now.append((d, s, n))
            need -= n
        if now:
            out.append(now)
    return out


def pack(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_length: int = SEQUENCE,
    end_id: int = 0,
    group_bytes: int = GROUP_BYTES,
    seed: int = 17,
) -> DataFrame:
    """Token pieces of all documents, packed into sequences of ``sequence_length`` ids.

    Returns one row per piece: ``doc_id, start, length, ids`` (binary, little-endian unsigned 32-bit),
    ``doc_tokens, sequence_id, offset``. A null or empty text is a document of only ``end_id``; a null
    id is kept as it is; rows with the same id and text are packed one by one; an empty table gives
    an empty result. Other columns of ``df`` are ignored, whatever their names. Rows are numbered in the order
    of their content inside each partition, so a partition that is computed again deals equal rows to the same groups.
    """
    small_batches(df.sparkSession)
    size = df.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    source = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).sortWithinPartitions("doc_id", "text")
    place = F.monotonically_increasing_id()
    source = source.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", place), F.lit(groups)))

    def encode(batches):
        tok = tokenizer(tokenizer_path)
        end = tok.pack([end_id])
        for batch in batches:
            ids = [x + end for x in tok.encode(batch.column("text").to_pylist())]
            width = pa.array([tok.width] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grp"), width, pa.array(ids, pa.binary())], ["doc_id", "grp", "width", "packed"]
            )
            del ids
            give_back()

    def pack_group(table: pa.Table) -> pa.Table:
        dtype = np.dtype(f"<u{table.column('width')[0].as_py()}")
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("packed", "ascending")])
        docs, packed = table.column("doc_id").to_pylist(), table.column("packed").to_pylist()
        first = table.column("grp")[0].as_py() << 24
        rows = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        lengths = [len(p) // dtype.itemsize for p in packed]
        for k, pieces in enumerate(pack_lengths(lengths, sequence_length)):
            offset = 0
            for d, start, n in pieces:
                part = np.frombuffer(packed[d], dtype, n, start * dtype.itemsize)
                for key, v in zip(rows, (docs[d], start, n, part.astype("<u4").tobytes(), lengths[d], first + k, offset)):
                    rows[key].append(v)
                offset += n
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.table([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))
        rows.clear()
        give_back()
        return out

    encoded = source.mapInArrow(encode, "doc_id long, grp long, width int, packed binary")
    return encoded.groupBy("grp").applyInArrow(
        pack_group,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
