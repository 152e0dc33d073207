"""Near-duplicates of documents as multisets of word shingles, by BagMinHash.

Each different shingle of a document carries Poisson processes over its discretised weight (its count):
one for the weights [0, 1), one for [1, 2), then [2, 4), [4, 8) ..., whose points are dealt further to
single weights by bits of a hash. A component of the signature is the earliest point among all shingles
whose weight the shingle reaches, so two components agree with the probability of the weighted Jaccard
similarity. Points are made in order of time and only up to a bound at which all components are filled,
so a long document costs little more than one random number a shingle.

Bands of the signature propose pairs, and the overlap of the whole multisets decides. A class is a
connected component of the pairs that reach the threshold; exact copies join as one. The number of bands
and their width follow from the threshold (``plan``).
"""

from __future__ import annotations

from math import ceil, comb, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import components
from quillmill.llm.shared import discard, heavy_join, materialize, release, small_batches
from quillmill.llm.substrings import blocks, mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: Buckets of more members are compared with a centre first.
SMALL = 16
#: A task compares two blocks of a bucket: so many signatures each, or so many bytes of multisets.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
DOC_BITS = 1 << 23


class Plan(NamedTuple):
    bands: int
    rows: int
    components: int
    #: Pairs that agree in no more components are left out.
    least_alike: int


def plan(threshold: float, miss: float = 2.5e-4, components: int = 64, overlooked: float = 1e-7) -> Plan:
    """The bands with which a pair at the threshold shares none with a probability of at most ``miss``.

    They are as wide as ``components`` allow, which grow where a low threshold needs it. A pair at the threshold
    agrees in ``least_alike`` components or fewer with a probability of at most ``overlooked``.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    number = lambda rows: max(1, ceil(log(miss) / log(max(1 - threshold**rows, 1e-300))))
    rows = max((r for r in range(1, 9) if number(r) * r <= components), default=1)
    components = max(components, number(rows) * rows)
    least, tail = -1, 0.0
    while (tail := tail + comb(components, least + 1) * threshold ** (least + 1) * (1 - threshold) ** (components - least - 1)) <= overlooked:
        least += 1
    return Plan(number(rows), rows, components, least)


class Shingles:
    """The different shingles of a block of texts: text number, hash, count, and the sizes of the texts."""

    def __init__(self, texts: list[str | None], size: int = SHINGLE):
        w, sizes = word_hashes(texts)
        begins = np.cumsum(sizes) - sizes
        n = len(w)
        padded = np.concatenate([w, np.zeros(size, np.uint64)])
        owner = np.repeat(np.arange(len(texts)), sizes)
        ends = np.repeat(begins + sizes, sizes)
        h = np.zeros(n, np.uint64)
        at = np.arange(n)
        for j in range(size):
            # beyond the end of a text counts as no word, so a short text is one shingle
            h = mix(h + np.where(at + j < ends, padded[at + j], np.uint64(0)) + np.uint64(j + 1))
        keep = (at + size <= ends) | (at == np.repeat(begins, sizes)) & (np.repeat(sizes, sizes) < size)
        h, owner = h[keep], owner[keep]
        # the order of words, for exact copies
        place = (at - np.repeat(begins, sizes)).astype(np.uint64)
        self.whole = [np.zeros(len(texts), np.uint64) for _ in range(2)]
        for salt, out in enumerate(self.whole):
            np.add.at(out, np.repeat(np.arange(len(texts)), sizes), mix(w + mix(place * np.uint64(2) + np.uint64(salt))))
        self.sizes = sizes
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.hash, self.owner = h[first], owner[first]
        self.count = np.diff(np.append(first, len(h)))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The multisets as sets: owner, and a 32-bit hash of the shingle and the number of its occurrence."""
        owner, count = np.repeat(self.owner, self.count), np.repeat(self.count, self.count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        del count
        return owner, (mix(np.repeat(self.hash, self.count) + mix(number.astype(np.uint64))) >> np.uint64(32)).astype(np.uint32)


def signatures(s: Shingles, components: int = 64) -> np.ndarray:
    """One row of 64-bit values per text; texts without words have zeros."""
    texts = len(s.sizes)
    weight = np.bincount(s.owner, s.count, texts)
    out = np.zeros((texts, components), np.uint64)
    todo, margin = weight > 0, 6.0
    while todo.any():
        bound = np.where(todo, (np.log(components) + margin) / np.maximum(weight, 1), 0)
        best = np.full(texts * components, np.inf)
        slots, times, names = [], [], []
        top, lo, hi, j = int(s.count.max()), 0, 1, 0
        while lo < top:
            use = np.flatnonzero((s.count > lo) & todo[s.owner])
            element, owner, count = s.hash[use], s.owner[use], s.count[use]
            seed = mix(element + mix(np.full(1, j * 2 + 1, np.uint64)))
            time, k = np.zeros(len(use)), 0
            while len(seed):
                name = mix(seed + np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)))
                time = time - np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (components * (hi - lo))
                alive = time <= bound[owner]
                seed, owner, count, time, name = seed[alive], owner[alive], count[alive], time[alive], name[alive]
                dealt = mix(name)
                component = (dealt % np.uint64(components)).astype(np.int64)
                # bits of the hash halve the interval again and again down to one weight
                level = lo + ((mix(dealt) >> np.uint64(32)) * np.uint64(hi - lo) >> np.uint64(32)).astype(np.int64)
                reached = level < count
                slot = (owner * components + component)[reached]
                slots.append(slot), times.append(time[reached]), names.append(name[reached])
                k += 1
            lo, hi, j = hi, hi * 2, j + 1
        slot, time, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        flat = out.reshape(-1)
        flat[slot[won]] = name[won]
        filled = np.isfinite(best).reshape(texts, components).all(1)
        todo, margin = todo & ~filled, margin * 3
    return out


def sketch(df: DataFrame, id_col: str, text_col: str, p: Plan) -> DataFrame:
    """``id, h`` (hash of the text), ``t1, t2`` (hashes of the words in order), ``n`` words, ``keys`` of the bands, ``sig`` (32 bits a component)."""
    docs = df.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"))

    def make(batches):
        for texts, ids, h in blocks(batches, "text", "id", "h"):
            s = Shingles(texts)
            sig = signatures(s, p.components)
            keys = np.zeros((len(texts), p.bands), np.uint64)
            for b in range(p.bands):
                k = np.full(len(texts), b + 1, np.uint64)
                for r in range(p.rows):
                    k = mix(k + sig[:, b * p.rows + r])
                keys[:, b] = k
            small = (sig >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(h, pa.int64()), pa.array(s.whole[0].view(np.int64)), pa.array(s.whole[1].view(np.int64)), pa.array(s.sizes),
                 pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in small], pa.binary())],
                ["id", "h", "t1", "t2", "n", "keys", "sig"],
            )

    return docs.mapInArrow(make, "id long, h long, t1 long, t2 long, n long, keys array<long>, sig binary")


def multisets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``uid, items`` (sorted 32-bit hashes) of the ``wanted (uid, id, t1, t2)`` texts."""
    from quillmill.llm.substrings import _hits, _sieve

    slot = lambda: F.pmod(F.xxhash64("id"), F.lit(DOC_BITS))
    sieve = df.sparkSession.sparkContext.broadcast(_sieve(wanted, slot(), DOC_BITS))

    @F.arrow_udf("boolean")
    def maybe(slots: pa.Array) -> pa.Array:
        return pa.array(_hits(sieve.value, slots.to_numpy(zero_copy_only=False)))

    docs = df.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id")).where(maybe(slot()))

    def make(batches):
        for texts, own in blocks(batches, "text", "id"):
            s = Shingles(texts)
            owner, item = s.items()
            order = np.lexsort((item, owner))
            item = item[order]
            ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
            parts = [np.unique(x).astype("<u4").tobytes() for x in np.split(item, ends[:-1])]
            t1, t2 = (pa.array(x.view(np.int64)) for x in s.whole)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), t1, t2, pa.array(parts, pa.binary())], ["id", "t1", "t2", "items"])

    made = docs.mapInArrow(make, "id long, t1 long, t2 long, items binary").dropDuplicates(["id", "t1", "t2"])
    return made.join(wanted, ["id", "t1", "t2"]).select("uid", "items")


def similar(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``a, b`` with ``n`` pairs of the same ``a`` whose multisets overlap enough."""

    @F.arrow_udf("boolean")
    def enough(x: pa.Array, y: pa.Array) -> pa.Array:
        left = [np.frombuffer(p.as_buffer(), "<u4") for p in x]
        right = [np.frombuffer(q.as_buffer(), "<u4") for q in y]
        return pa.array([min(len(p), len(q)) >= threshold * max(len(p), len(q)) and overlap(p, q) >= threshold for p, q in zip(left, right)], pa.bool_())

    one = pairs.join(items.select(F.col("uid").alias("b"), F.col("items").alias("b_items")), "b")
    centres = pairs.groupBy("a").agg(F.count("*").alias("n")).join(items.select(F.col("uid").alias("a"), F.col("items").alias("a_items")), "a")
    return heavy_join(one, centres, ["a"], "n").where(enough("b_items", "a_items")).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: ``id, h`` (xxhash64 of its text), ``n`` words, ``class_id`` (least id of its class), ``copy_of`` (least id with the same words),
    ``class_h`` (least hash of a text that the least id has in the class).

    Where several texts have one id, classes can have the same least id; ``class_id`` and ``class_h`` together name a class, and
    the row of that id and hash represents it.

    Texts of fewer than five words are one shingle. Null and empty texts are classes of their own, and so
    are rows without an id, whose class is null; of rows of one id, each goes by its own text. Further columns
    play no part. An empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    p = plan(threshold)
    # a number for every row, which stays since the table is written
    drawn = materialize(sketch(df, id_col, text_col, p).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    rows = drawn.count()
    known = drawn.where("n > 0 and id is not null")
    least = F.min(F.struct("id", "h", "uid")).alias("first")
    reps = known.groupBy("t1", "t2").agg(least, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    reps = materialize(reps.select("first.*", "t1", "t2", "n", "keys", "sig", "copies"), "texts", rows)
    bands = reps.select("uid", F.explode("keys").alias("key"))
    buckets = materialize(bands.groupBy("key").agg(F.min("uid").alias("centre"), F.count("*").alias("n")).where("n > 1"), "buckets", rows)
    members = materialize(heavy_join(bands, buckets.withColumn("size", F.col("n")), ["key"], "n"), "members", p.bands * rows)
    wanted = reps.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "id", "t1", "t2")
    release(df.sparkSession)
    items = materialize(multisets(df, id_col, text_col, wanted), "multisets")
    release(df.sparkSession)
    # in large buckets most members are near the centre, which leaves little to compare with each other
    stars = members.where((F.col("size") > SMALL) & (F.col("uid") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("uid").alias("b"))
    pairs = materialize(stars.distinct(), "pairs", rows)
    near = materialize(similar(pairs, items, threshold), "links", rows)
    release(df.sparkSession)
    label = components(near, rows)
    within = materialize(_within_buckets(members, label, reps, items, threshold, p, rows), "links", rows)
    release(df.sparkSession)
    label = components(near.unionByName(within), rows)
    classes = reps.select("uid", "t1", "t2", F.col("id").alias("copy_of"), "h", F.col("copies").alias("of_text")).join(label.withColumnRenamed("id", "uid"), "uid", "left")
    classes = materialize(classes.withColumn("c", F.coalesce("label", "uid")), "classes", rows)
    least = classes.groupBy("c").agg(F.min(F.struct("copy_of", "h")).alias("least"), F.count("*").alias("of_c"))
    least = least.select("c", F.col("least.copy_of").alias("class_id"), F.col("least.h").alias("class_h"), "of_c")
    named = materialize(heavy_join(classes, least, ["c"], "of_c").select("t1", "t2", "copy_of", "class_id", "class_h", "of_text"), "classes", rows)
    discard(reps, buckets, members, items, pairs, near, within, classes)
    release(df.sparkSession)
    linked = heavy_join(known.select("id", "h", "n", "t1", "t2"), named, ["t1", "t2"], "of_text").select("id", "h", "n", "class_id", "copy_of", "class_h")
    alone = drawn.where("n = 0 or id is null").select("id", "h", "n", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.col("h").alias("class_h"))
    return linked.unionByName(alone)


def _within_buckets(members: DataFrame, label: DataFrame, reps: DataFrame, items: DataFrame, threshold: float, p: Plan, rows: int) -> DataFrame:
    """Links ``a, b`` between texts of different classes that share a bucket.

    Members of a bucket are dealt to blocks, and each task compares two of these; a pair counts in the
    first bucket that it shares. Signatures alone tell which members have a partner that may be near enough; the multisets
    of only these meet, again in blocks, and what comes back joins classes not yet joined in the task, so it
    is no more than members.
    """
    now = members.select("key", "uid").join(label.withColumnRenamed("id", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    now = materialize(now, "labelled", p.bands * rows)
    open_ = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    open_ = materialize(open_.select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open", rows)
    signed = reps.select("uid", "sig", "keys", "n")
    seen = heavy_join(now, open_, ["key"], "n").join(signed, "uid")

    def look(key, table):
        own, mine = _Block(table, key, p), np.zeros(table.num_rows, bool)
        for x, partners in own.pairs(threshold):
            mine[x], mine[partners] = True, True
        return pa.table({"key": pa.array([key[0].as_py()] * int(mine.sum()), pa.int64()), "uid": table.column("uid").combine_chunks().filter(pa.array(mine))})

    maybe = _blocks(seen, ["uid", "label", "sig", "keys", "n"]).applyInArrow(look, "key long, uid long").distinct()
    maybe = materialize(maybe.join(items.select("uid", F.octet_length("items").alias("bytes")), "uid"), "promising", p.bands * rows)
    release(members.sparkSession)
    sizes = maybe.groupBy("key").agg(F.count("*").alias("of_key"), F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    near = heavy_join(maybe.select("key", "uid"), materialize(sizes, "sizes", rows), ["key"], "of_key")
    near = near.join(label.withColumnRenamed("id", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid")).join(signed, "uid").join(items, "uid")

    def compare(key, table):
        own = _Block(table, key, p)
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("items")]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        uids, labels = own.uid.tolist(), own.label.tolist()
        links: list[tuple[int, int]] = []
        for x, partners in own.pairs(threshold):
            for y in partners.tolist():
                if find(labels[x]) != find(labels[y]) and overlap(sets[x], sets[y]) >= threshold:
                    root[find(labels[x])] = find(labels[y])
                    links.append((min(uids[x], uids[y]), max(uids[x], uids[y])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    out = _blocks(near, ["uid", "label", "sig", "keys", "n", "items"]).applyInArrow(compare, "a long, b long")
    return out


def _blocks(rows: DataFrame, columns: list[str]):
    """The rows of each ``key`` in groups of two of its ``blocks`` (or one, with itself)."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns).groupBy("key", "i", "j")


class _Block:
    """Signatures of the members of two blocks of a bucket."""

    def __init__(self, table: pa.Table, key: tuple, p: Plan):
        self.key, self.i, self.j = (x.as_py() for x in key)
        self.uid, self.label, self.block = (table.column(c).to_numpy() for c in ("uid", "label", "block"))
        self.size = np.maximum(table.column("n").to_numpy() - SHINGLE + 1, 1)
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, p.components)
        self.keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, p.bands)
        self.least = p.least_alike

    def pairs(self, threshold: float):
        """Members, each with partners that may be near enough, the likeliest first, in an order that does not depend on that of the rows."""
        order = np.argsort(self.uid, kind="stable")
        left, right = order[self.block[order] == self.i], order[self.block[order] == self.j]
        at = int(np.flatnonzero(self.keys[order[0]] == self.key)[0])
        for x in left.tolist():
            y = right[self.label[right] != self.label[x]]
            if self.i == self.j:
                y = y[self.uid[y] > self.uid[x]]
            y = y[np.minimum(self.size[y], self.size[x]) >= threshold * np.maximum(self.size[y], self.size[x])]
            if at and len(y):  # pairs of an earlier bucket are compared there
                y = y[~(self.keys[y, :at] == self.keys[x, :at]).any(1)]
            if len(y):
                alike = (self.sig[y] == self.sig[x]).sum(1)
                few = np.flatnonzero(alike > self.least)
                if len(few):
                    yield x, y[few[np.argsort(-alike[few], kind="stable")]]


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    few, many = (x, y) if len(x) < len(y) else (y, x)
    if not len(few):
        return 0.0
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return both / (len(x) + len(y) - both)
