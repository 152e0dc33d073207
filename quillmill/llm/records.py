"""Token ids as length-delimited binary records with masked checksums and an offset index.

A shard is a run of records in ascending document order. A record is framed as

    uint64 n, uint32 masked crc of those 8 bytes, n bytes of payload, uint32 masked crc of the payload

(little-endian); its payload is a flag byte (1: the id is null), the int64 document id and the token
ids as unsigned integers of the width given in the file's 8-byte header. Beside each shard stands an
index: the int64 offset of every record and the file's length, so that records can be read in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.shared import fresh_dir, small_batches
from quillmill.llm.tokens import forget, tokenizer

MAGIC = b"QMREC1"
SHARD_BYTES = 16_000_000  # of text behind a shard, on average
#: Shards at most; they are larger where that is too few. The driver holds a row for each.
SHARDS = 50_000


def masked_crc(data: bytes) -> int:
    """The crc turned by 15 bits plus a constant, so that a crc over data with crcs in it stays useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def payload_of(doc_id: int | None, packed: bytes) -> bytes:
    return struct.pack("<Bq", doc_id is None, doc_id or 0) + packed


def shard_bytes(records: list[bytes], width: int) -> tuple[bytes, bytes]:
    """A shard's content and its index."""
    framed = [frame(r) for r in records]
    header = MAGIC + struct.pack("<H", width)
    offsets = np.cumsum([len(header), *map(len, framed)], dtype="<i8")
    return header + b"".join(framed), offsets.tobytes()


def read_record(content: bytes, offset: int) -> bytes:
    size = content[offset : offset + 8]
    (n,), (crc,) = struct.unpack("<Q", size), struct.unpack_from("<I", content, offset + 8)
    if crc != masked_crc(size):
        raise ValueError(f"broken length at byte {offset}")
    payload = content[offset + 12 : offset + 12 + n]
    if len(payload) != n or struct.unpack_from("<I", content, offset + 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"broken record at byte {offset}")
    return payload


def read_shard(content: bytes, index: bytes | None = None, order=None):
    """(document id, packed ids, width) of each record; ``order`` picks records by number through the index."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of records")
    (width,) = struct.unpack_from("<H", content, len(MAGIC))
    offsets = np.frombuffer(index, "<i8") if index is not None else None
    at, k = len(MAGIC) + 2, 0
    picks = iter(range(len(offsets) - 1) if order is None else order) if offsets is not None else None
    while True:
        if picks is not None:
            k = next(picks, -1)
            if k < 0:
                return
            at = int(offsets[k])
        elif at >= len(content):
            return
        payload = read_record(content, at)
        null, doc = struct.unpack_from("<Bq", payload)
        yield None if null else doc, payload[9:], width
        at += 16 + len(payload)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    """Whole or not at all: an attempt writes a name of its own, then moves it into place, over what an earlier attempt left there."""
    files, path = _open(uri)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        out.write(data)
    try:
        files.move(own, path)
    except OSError:  # some stores do not move onto a file that exists
        files.delete_file(path)
        files.move(own, path)


def _get(uri: str) -> bytes:
    files, path = _open(uri)
    with files.open_input_stream(path) as source:
        return source.read()


def write_records(
    df: DataFrame,
    tokenizer_path: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    shard_text_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode every text and write shards in ascending id order; returns the manifest, one row per shard.

    The id range is cut at quantiles of the ids, so shards are balanced without a second run of the
    encoder; rows of an id (or of none) that alone would fill a shard are dealt to as many as they fill. Null ids
    come first; rows of equal ids have no order among shards and that of their tokens inside. A null text is a document
    of only ``end_id``. An empty table gives no shard. A task that runs again replaces its shards by
    equal ones. Columns of ``df`` besides the two named play no part.
    """
    spark = df.sparkSession
    small_batches(spark)
    size = df.agg(F.sum(F.octet_length(F.col(text_col))), F.count(F.lit(1))).first()
    shards, rows = min(SHARDS, max(1, -(-int(size[0] or 0) // shard_text_bytes))), size[1]
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts: list[int] = []
    if shards > 1:
        at = [i / shards for i in range(1, shards)]
        cuts = source.agg(F.percentile_approx("doc_id", at, min(100 * shards, 1_000_000))).first()[0] or []
    bounds = np.unique(np.asarray(cuts, dtype=np.int64))
    # ids that fill a shard by themselves: no more than shards, and each is a bound or null
    heavy: dict[int | None, int] = {}
    if shards > 1:
        counts = source.where(F.col("doc_id").isNull() | F.col("doc_id").isin([int(b) for b in bounds[np.flatnonzero(np.bincount(np.searchsorted(bounds, cuts)) > 1)]]))
        for r in counts.groupBy("doc_id").count().where(F.col("count") * shards > 2 * rows).collect():
            heavy[r["doc_id"]] = -(-r["count"] * shards // rows)
    known = np.array(sorted(k for k in heavy if k is not None), np.int64)
    parts = np.array([heavy[k] for k in known.tolist()], np.int64)
    source = source.withColumn("place", F.xxhash64(F.monotonically_increasing_id()))

    def encode(batches):
        import zstandard

        tok = tokenizer(tokenizer_path)
        end, squeeze = tok.pack([end_id]), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = [squeeze.compress(x + end) for x in tok.encode(batch.column("text").to_pylist())]
            docs = batch.column("doc_id")
            plain, null = docs.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False)
            shard, part = np.searchsorted(bounds, plain, "left"), np.zeros(len(plain), np.int64)
            place = batch.column("place").to_numpy().view(np.uint64)
            if len(known):  # behind the smaller ids of their range
                at = np.minimum(np.searchsorted(known, plain), len(known) - 1)
                own = (known[at] == plain) & ~null
                part[own] = 1 + (place[own] % parts[at[own]].astype(np.uint64)).astype(np.int64)
            if None in heavy:  # in front of all
                part[null] = -1 - (place[null] % np.uint64(heavy[None])).astype(np.int64)
            width = pa.array([tok.width] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(shard.astype(np.int32)), pa.array(part.astype(np.int32)), width, pa.array(ids, pa.binary())], ["doc_id", "range", "part", "width", "packed"]
            )

    def store(key, table):
        import zstandard

        forget(tokenizer_path)
        width, shard, part = table.column("width")[0].as_py(), key[0].as_py(), key[1].as_py()
        open_up = zstandard.ZstdDecompressor()
        rows = [(d is not None, d or 0, open_up.decompress(p)) for d, p in zip(table["doc_id"].to_pylist(), table["packed"].to_pylist())]
        rows.sort()
        content, index = shard_bytes([payload_of(d if known else None, p) for known, d, p in rows], width)
        name = f"shard-{shard:08d}{part:+07d}" if part else f"shard-{shard:08d}"
        _put(f"{folder}/{name}.rec", content)
        _put(f"{folder}/{name}.idx", index)
        tokens = sum(len(p) for _, _, p in rows) // width
        values = [[shard], [part], [f"{name}.rec"], [len(rows)], [tokens], [len(content)]]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(values, types)], names=["range", "part", "file", "records", "tokens", "bytes"])

    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    written = (
        source.mapInArrow(encode, "doc_id long, range int, part int, width int, packed binary")
        .groupBy("range", "part")
        .applyInArrow(store, "range int, part int, file string, records long, tokens long, bytes long")
    )
    # a row per shard of shard_text_bytes: the driver adds up the offsets of the shards
    rows = sorted(written.collect())
    start, manifest = 0, []
    for number, r in enumerate(rows):
        manifest.append((number, r["file"], r["records"], r["tokens"], r["bytes"], start))
        start += r["tokens"]
    schema = "shard int, file string, records long, tokens long, bytes long, first_token long"
    return spark.createDataFrame(manifest, schema)


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """All records of the shards: ``doc_id, start`` (ids before it, over all shards), ``n_tokens, ids`` (little-endian u32).

    The manifest is dealt to the tasks, which open the shards through their indexes; every checksum is verified.
    """
    shards = manifest.select(F.col("file"), "first_token").repartition(max(1, manifest.count()))

    def parse(batches):
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first_token").to_pylist()):
                docs, starts, sizes, ids = [], [], [], []
                at, held = first, 0
                for doc, packed, width in read_shard(_get(f"{folder}/{name}"), _get(f"{folder}/{name[:-4]}.idx")):
                    wide = packed if width == 4 else np.frombuffer(packed, f"<u{width}").astype("<u4").tobytes()
                    docs.append(doc), starts.append(at), sizes.append(len(wide) // 4), ids.append(wide)
                    at += len(wide) // 4
                    held += len(wide)
                    if held > 8_000_000:
                        yield _record_batch(docs, starts, sizes, ids)
                        docs, starts, sizes, ids, held = [], [], [], [], 0
                if docs:
                    yield _record_batch(docs, starts, sizes, ids)

    return shards.mapInArrow(parse, "doc_id long, start long, n_tokens long, ids binary")


def _record_batch(docs, starts, sizes, ids) -> pa.RecordBatch:
    arrays = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])


def round_trip(df: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write all records of ``df`` and give them as read back from the files."""
    folder = folder or fresh_dir(df.sparkSession, "records")
    manifest = write_records(df, tokenizer_path, folder, **options)
    return read_records(df.sparkSession, folder, manifest)
