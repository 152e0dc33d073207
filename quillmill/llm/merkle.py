"""A manifest of a dataset as a Merkle tree: every row's digest, the digest of each group and of all, and a proof for each row.

A group's leaves stand in order; of every 16 consecutive nodes one becomes their hash until one is left. Leaves are dealt to
aligned blocks of 16^3; a recursive traversal of a block returns the digest of a subtree and, while it unwinds, appends the siblings to
the leaves the subtree contains. The roots of blocks are the leaves of the next distributed traversal, and so on; the groups'
roots make one more tree. Proofs grow from the top: each block is handed what stands above it.

A proof is text: for each level the digests left of the node, a colon, those right of it, and a comma.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillmill.llm.shared import discard, free_name, materialize

FANOUT = 16
#: Levels inside an aligned block, and so its leaves.
HEIGHT = 3
BLOCK = FANOUT**HEIGHT


def canonical(*columns: Column) -> Column:
    """Each value as ``-`` if null, else its bytes in UTF-8, a colon and itself; one behind the other."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[part(c.cast("string")) for c in columns])


def leaf(*columns: Column) -> Column:
    return F.sha2(canonical(*columns), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings make, level by level."""
    levels = F.filter(F.split(proof, ",", -1), lambda x: x != "")
    up = lambda d, x: F.sha2(F.concat(F.substring_index(x, ":", 1), d, F.substring_index(x, ":", -1)), 256)
    return F.aggregate(levels, digest, up)


def siblings(proof: Column) -> Column:
    """The digests of a proof one behind the other."""
    return F.translate(proof, ":,", "")


# ---- a block


def height_of(n: int) -> int:
    """Levels inside a block of a tree of ``n`` nodes: as many as the tree has, ``HEIGHT`` at most."""
    h = 0
    while h < HEIGHT and FANOUT**h < n:
        h += 1
    return h


def traverse(digests: list[str], height: int, above: str | None = None) -> tuple[str, list[str]]:
    """The digest of a block's tree and, where ``above`` is given, the proof of each of its leaves."""
    proofs: list[list[str]] = [[] for _ in digests] if above is not None else []

    def visit(low: int, high: int, level: int) -> str:
        if not level:
            return digests[low]
        step = FANOUT ** (level - 1)
        starts = range(low, high, step)
        children = [visit(i, min(i + step, high), level - 1) for i in starts]
        if proofs:
            for j, i in enumerate(starts):
                level_text = f"{''.join(children[:j])}:{''.join(children[j + 1:])},"
                for mine in proofs[i : min(i + step, high)]:
                    mine.append(level_text)
        return hashlib.sha256("".join(children).encode()).hexdigest()

    root = visit(0, len(digests), height)
    return root, ["".join(p) + above for p in proofs]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Runs of rows of one group and block out of sorted batches, as tables; a block is at most ``BLOCK`` rows."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        groups, numbers = b.column("g").to_pylist(), b.column("block").to_pylist()
        at = 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or (groups[i], numbers[i]) != (groups[at], numbers[at]):
                mine = (groups[at], numbers[at])
                if held and mine != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = mine
                held.append(b.slice(at, i - at))
                at = i
    if held:
        yield key, pa.Table.from_batches(held)


def _dealt(nodes: DataFrame) -> DataFrame:
    """Rows of one block beside each other and in order."""
    return nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).repartition("g", "block").sortWithinPartitions("g", "block", "at")


def _roots(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes (g, at, n, digest)`` to the roots of their blocks, of the same columns."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), rows in _blocks(batches):
            n = rows.column("n")[0].as_py()
            root, _ = traverse(rows.column("digest").to_pylist(), height_of(n))
            yield pa.RecordBatch.from_pydict({"g": [g], "at": [block], "n": [-(-n // BLOCK)], "digest": [root]})

    rows = _dealt(nodes.select("g", "at", "n", "digest"))
    return materialize(rows.mapInArrow(climb, "g string, at long, n long, digest string"), name)


def _proved(nodes: DataFrame, above: DataFrame, carry: list[str], given: list[str]) -> DataFrame:
    """``nodes (g, at, n, digest, carry...)`` with their ``proof``: inside the block, then what ``above (g, at, proof, given...)`` says of its root.

    A block's row of ``above`` is dealt like its nodes and comes first, so nothing is copied to each node before its task.
    """
    types = {f.name: f.dataType for f in nodes.schema.fields + above.schema.fields}
    mine = ["g", "block", "at", "n", "digest", *carry, "proof", *given]
    null = lambda c: F.lit(None).cast(types[c]).alias(c)
    head = above.withColumns({"block": F.col("at"), "at": F.lit(-1).cast("long")})
    body = nodes.withColumn("block", F.floor(F.col("at") / BLOCK))
    both = [rows.select(*[F.col(c) if c in rows.columns else null(c) for c in mine]) for rows in (head, body)]
    out = ["g", "at", "digest", *carry, "proof", *given]
    schema = StructType([StructField(c, types[c]) for c in out])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches):
            first, rows = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
            _, proofs = traverse(rows.column("digest").to_pylist(), height_of(rows.column("n")[0].as_py()), first["proof"])
            columns = {"proof": proofs} | {c: [first[c]] * len(proofs) for c in given}
            table = pa.table([pa.array(columns[c], pa.string()) if c in columns else rows.column(c) for c in out], names=out)
            yield from table.to_batches(max_chunksize=512)

    dealt = both[0].unionByName(both[1]).repartition("g", "block").sortWithinPartitions("g", "block", "at")
    return dealt.mapInArrow(descend, schema)


def _tree(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes and the roots of blocks above them, until every group has one."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(levels) == 1:
        levels.append(_roots(levels[-1], f"{name}-{len(levels)}"))
        most = -(-most // BLOCK)
    return levels


def _proofs(levels: list[DataFrame], top: DataFrame, carry: list[str], given: list[str], name: str) -> DataFrame:
    """Proofs of the lowest level; ``top (g, at, proof, given...)`` is what stands above each group's root and what all below it are told."""
    above = top
    for k in range(len(levels) - 2, 0, -1):
        above = materialize(_proved(levels[k], above, [], given), f"{name}-proof-{k}")
    return _proved(levels[0], above, carry, given)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the place in the group from 0, and ``n``, the group's rows; written on the way.

    Rows are dealt by ranges of group and order; each range counts its own, and only counts (one for each group of each
    range) are added up, so a group of any size stays spread.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__m", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumns({"__part": F.shiftright("__m", 33), "__row": F.col("__m").bitwiseAND((1 << 33) - 1)}).drop("__m"), name)
    counts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    mine = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "__part", "__first", before.alias("__before"), F.sum("__n").over(mine).alias("n"))
    return ranged.join(counts, [group, "__part"]).withColumn("at", F.col("__before") + F.col("__row") - F.col("__first")).drop("__part", "__row", "__first", "__before")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, group, leaf, subroot, root, proof`` of every row, and the columns ``carry`` of ``docs`` under their names.

    A leaf is the hash of the row's ``columns``; groups are the values of ``group_col``, null first, then bytewise; leaves of a
    group ascend by id (null first), then by their digest, so repeated rows are as many equal leaves. A group of one row
    is its own subroot, and one group's subroot is the root; such levels add nothing to a proof. An empty table has an empty result.
    A carried column may not be named like those of the result. Other columns do not come along and may have any name.
    """
    kept = {c: free_name(docs, f"carry_{i}") for i, c in enumerate(carry)}
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))  # a null before all others
    rows = docs.select(
        key.alias("g"), F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf(*[F.col(f"`{c}`") for c in columns]).alias("digest"),
        *[F.col(f"`{c}`").alias(n) for c, n in kept.items()],
    )
    written = materialize(rows, "leaves")
    leaves = materialize(numbered(written, "g", ["id", "digest"], "ranges"), "numbered")
    discard(written)
    levels = _tree(leaves, "blocks")
    subroots = levels[-1].select(F.lit("").alias("all"), F.col("g").alias("name"), "digest")
    groups = materialize(numbered(subroots, "all", ["name"], "groups").select(F.col("all").alias("g"), "at", "n", "digest", "name"), "places")
    upper = _tree(groups, "above")
    root = upper[-1].select("g", "at", F.lit("").alias("proof"), F.col("digest").alias("root"))
    of_groups = materialize(_proofs(upper, root, ["name"], ["root"], "above"), "subroots")
    top = of_groups.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("at"), "proof", F.col("digest").alias("subroot"), "root")
    proved = _proofs(levels, top, ["id", "group", *kept.values()], ["subroot", "root"], "blocks")
    return proved.select("id", "group", F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(n).alias(c) for c, n in kept.items()])
