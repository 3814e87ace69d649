"""Media columns by content-defined chunking (operator 10).

A payload is cut where a rolling gear hash has its low bits zero. Chunks are named by their SHA-256; a Spark aggregation gives each name one
owner among the distinct payloads. A payload is stored as one object: a header, its ordered chunk list, and the samples of those
chunks that it owns. What it does not own is fetched by a join on the name when the object is read back, and every chunk is verified. Sizes and digests of
the stored form are those of the object's bytes as read. Only names, and the bytes of shared chunks, are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, small_batches

UNIT, TAIL = 192, 16
#: Chunk sizes: least, by the mask on average that much more, most.
LEAST, MASK, MOST = 512, np.uint32(0x7FF), 8192
PIECE, REACH = 1 << 20, 32
_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)
_CHUNKS = "array<struct<d:binary,n:int>>"
_CHUNK_TYPE = pa.list_(pa.struct([("d", pa.binary()), ("n", pa.int32())]))


def payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8, null as empty, with spaces up to a positive multiple of UNIT; bytes without those)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    x = np.frombuffer(data, np.uint8)
    found = []
    for a in range(0, len(x), PIECE):
        lead = min(a, REACH - 1)
        h = _GEAR[x[a - lead : a + PIECE]]
        s = 1
        while s < REACH:  # twice the bytes in the sum each time
            wider = h.copy()
            wider[s:] += h[:-s] << np.uint32(s)
            h, s = wider, 2 * s
        found.append(np.flatnonzero((h[lead:] >> np.uint32(16)) & MASK == 0) + a + 1)
    at = np.concatenate(found)
    out, start, n = [], 0, len(x)
    while n - start > LEAST:
        k = int(np.searchsorted(at, start + LEAST))
        end = min(int(at[k]) if k < len(at) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunked(data: bytes) -> list[tuple[bytes, bytes]]:
    """(SHA-256, bytes) of each chunk."""
    ends = cuts(data)
    return [(hashlib.sha256(c).digest(), c) for a, e in zip([0, *ends], ends, strict=False) for c in [data[a:e]]]


def key_of(n_bytes: int, names: list[bytes]) -> bytes:
    return hashlib.sha256(struct.pack("<q", n_bytes) + b"".join(names)).digest()


def stored(n_bytes: int, chunks: list[tuple[bytes, bytes]], away: set[int] = frozenset()) -> bytes:
    """The object of a payload: header, chunk list with each name and size, samples of the chunks but those `away`, whose sizes are written as -1 - size."""
    sizes = [-1 - len(c) if k in away else len(c) for k, (_, c) in enumerate(chunks)]
    return b"".join([b"SVM2", struct.pack("<qi", n_bytes, len(chunks)), *(d + struct.pack("<i", n) for (d, _), n in zip(chunks, sizes, strict=True)), *(c for k, (_, c) in enumerate(chunks) if k not in away)])


def own_chunks(media: bytes) -> tuple[int, list[tuple[bytes, bytes | None]]]:
    """(bytes without padding, name and samples of each chunk, None where they are stored elsewhere) of an object."""
    if media[:4] != b"SVM2":
        raise ValueError("not a stored payload")
    n_bytes, n = struct.unpack_from("<qi", media, 4)
    at, out = 16 + 36 * n, []
    for k in range(n):
        name, (size,) = media[16 + 36 * k : 48 + 36 * k], struct.unpack_from("<i", media, 48 + 36 * k)
        out.append((name, media[at : at + size] if size >= 0 else None))
        at += max(0, size)
    if at != len(media):
        raise ValueError("not of the length that its chunk list tells")
    return n_bytes, out


def opened(media: bytes, lent: dict[int, bytes] | None = None) -> tuple[int, bytes]:
    """(bytes without padding, payload) of an object and the chunks lent to it; ValueError where a chunk is not what its name says."""
    n_bytes, chunks = own_chunks(media)
    whole = [(lent or {}).get(k, b"") if c is None else c for k, (_, c) in enumerate(chunks)]
    for k, ((name, _), c) in enumerate(zip(chunks, whole, strict=True)):
        if hashlib.sha256(c).digest() != name:
            raise ValueError(f"chunk {k} is damaged")
    return n_bytes, b"".join(whole)


def feature(samples: bytes, chunks: int) -> str:
    count = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, v = int(count.sum()), np.arange(256)
    mean = float((count * v).sum()) / n
    p = count[count > 0] / n
    return f"chunks={chunks};mean={mean:.4f};std={float(np.sqrt((count * (v - mean) ** 2).sum() / n)):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sizes, lists = [], [], []
        for t in b.column("text"):
            data, n = payload(t.as_py())
            got = chunked(data)
            sizes.append(n)
            keys.append(key_of(n, [d for d, _ in got]))
            lists.append([{"d": d, "n": len(c)} for d, c in got])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, _CHUNK_TYPE)], ["doc_id", "t", "n_bytes", "key", "chunks"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of the texts that stand for their payload; `copy` tells which do not, `away` which chunks are owned elsewhere."""
    for b in batches:
        keys, media, owes = [], [], []
        for t, copy, away in zip(b.column("text"), b.column("copy").to_pylist(), b.column("away").to_pylist(), strict=True):
            if copy:
                continue
            data, n = payload(t.as_py())
            got = chunked(data)
            keys.append(key_of(n, [d for d, _ in got]))
            media.append(stored(n, got, set(away or ())))
            owes.append(bool(away))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(media, pa.binary()), pa.array(owes, pa.bool_())], ["key", "media", "owes"])


def _lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = []
        for media, ks in zip(b.column("media"), b.column("ks").to_pylist(), strict=True):
            chunks = own_chunks(media.as_py())[1]
            got += [chunks[k] for k in ks]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.binary()), pa.array([c for _, c in got], pa.binary())], ["d", "c"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, media, lent in zip(b.column("key"), b.column("media"), b.column("lent"), strict=True):
            got = media.as_py()
            n, data = opened(got, {x["k"].as_py(): x["c"].as_py() for x in lent} if lent.is_valid else {})
            rows.append((key.as_py(), len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-TAIL:]), len(got), hashlib.sha256(got).digest(), feature(data, len(own_chunks(got)[1]))))
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(spark: SparkSession, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(made, media, refs, loans): the payload of each row; the store, an object a distinct payload; (key, k, d) of chunks that a payload does not own; (key, k, d) of those that others need."""
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    made = scratch.table(rows.mapInArrow(_names, f"doc_id {kind}, t binary, n_bytes long, key binary, chunks {_CHUNKS}"), "made")
    firsts = made.groupBy("key").agg(F.min(F.struct("doc_id", "t", "chunks")).alias("f")).select("key", "f.*")
    firsts = scratch.table(firsts, "firsts")
    chunks = firsts.select("key", F.posexplode("chunks").alias("k", "x")).select("key", "k", "x.d")
    owners = chunks.groupBy("d").agg(F.min(F.struct("key", "k")).alias("o"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d", F.col("o.key").alias("o_key"), F.col("o.k").alias("o_k"))
    owners = scratch.table(owners, "owners")
    refs = scratch.table(chunks.join(bounded(owners, 120), "d").where("key != o_key OR k != o_k").select("key", "k", "d"), "refs")
    loans = owners.select(F.col("o_key").alias("key"), F.col("o_k").alias("k"), "d")
    away = refs.groupBy("key").agg(F.collect_list("k").alias("away"))  # of one payload's chunks
    # by id and text; rows that are equal in both are one
    kinds = made.groupBy("doc_id", "t").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("c"))
    odd = kinds.join(firsts.select("key", F.col("doc_id").alias("f_")), "key").join(away, "key", "left")
    odd = odd.select(F.col("doc_id").alias("o_id"), F.col("t").alias("o_t"), (~F.col("doc_id").eqNullSafe(F.col("f_"))).alias("copy"), "away", (F.col("c") > 1).alias("twice")).where("copy OR twice OR away IS NOT NULL")
    odd = bounded(scratch.table(odd, "odd"), 120)
    told = rows.join(odd, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("t") == F.col("o_t")), "left").select("doc_id", "t", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "away", F.coalesce("twice", F.lit(False)).alias("twice"))
    out = "key binary, media binary, owes boolean"
    media = told.where("NOT twice").select("text", "copy", "away").mapInArrow(_objects, out)
    if odd.where("twice").limit(1).count():
        once = told.where("twice AND NOT copy").dropDuplicates(["doc_id", "t"]).select("text", "copy", "away")
        media = media.union(once.mapInArrow(_objects, out))
    return made, scratch.table(media, "media"), refs, loans


def read_back(media: DataFrame, refs: DataFrame, loans: DataFrame, scratch: Scratch) -> DataFrame:
    """key, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each stored payload, from the stored bytes."""
    lenders = bounded(scratch.table(loans.groupBy("key").agg(F.collect_list("k").alias("ks")), "lenders"), 80)
    lent = media.join(lenders, "key").select("media", "ks").mapInArrow(_lend, "d binary, c binary")
    fetched = refs.join(lent, "d").groupBy("key").agg(F.collect_list(F.struct("k", "c")).alias("lent"))  # of one payload's chunks
    empty = F.lit(None).cast("array<struct<k:int,c:binary>>")
    out = "key binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
    whole = media.where("NOT owes").select("key", "media", empty.alias("lent")).mapInArrow(_read, out)
    joined = media.where("owes").join(fetched, "key").select("key", "media", "lent").mapInArrow(_read, out)
    return whole.union(joined)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document.

    Nulls: a null text is empty, a payload of one unit of spaces; a null doc_id is kept. Repeated rows are returned each; equal texts are stored once.
    media_bytes and media_sha256 are of the stored object, without chunks that other objects hold. Empty tables give no rows. Other columns are not read. Long texts are hashed piece by piece; a task holds one payload, not its group of copies."""
    scratch = Scratch(spark, "media")
    made, media, refs, loans = store(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    back = scratch.table(read_back(media, refs, loans, scratch), "back")
    # nearly as many payloads as documents: never a side to broadcast
    out = made.select("doc_id", "n_bytes", "key").join(back.hint("merge"), "key")
    sha = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_bytes", "payload_bytes", sha("payload_sha256"), "tail_crc32", "media_bytes", sha("media_sha256"), "feature")
