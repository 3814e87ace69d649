"""Substring dedup with a compressed FM-index per shard (operator 7).

A window is 50 consecutive words. Its least 16-word hash is its anchor; equal windows have equal anchors, so that only windows whose anchor
occurs in two documents can repeat. Consecutive windows of one anchor are a segment. Equal segments are collapsed to the least
document; the distinct ones are dealt by anchor to shards of bounded size. A shard's segments are indexed, and each is streamed
through backward search, which gives its matching statistics: from each word, the length of the longest match that occurs in a
document with a smaller id. Stretches of 50 words and more are reported. Windows of an anchor with very many different segments
are segments of their own, under their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, small_batches
from .fmindex import FMIndex
from .words import PLAIN, Words, _inverse, mix, pieces, powers

WINDOW, ANCHOR = 50, 16
SPREAD = WINDOW - ANCHOR + 1
#: An anchor with more different segments than this, about, is hot: its windows are routed by their own hashes. Words of a shard, about.
HOT, SHARD_WORDS = 4000, 150_000
_BASES = (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def _least_of_runs(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    n = 1
    while 2 * n <= k:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (k - n)], x[k - n :]) if n < k else x


def _runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window as a word position, windows, anchor) of the runs of windows with one anchor, SPREAD windows at most."""
    ok = w.within(WINDOW)
    if not ok.any():
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    least = _least_of_runs(w.grams(ANCHOR), SPREAD)
    at = np.flatnonzero(ok)
    a = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    parts = -(-size // SPREAD)
    base = np.repeat(first, parts)
    k = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
    n = np.minimum(SPREAD, np.repeat(size, parts) - k * SPREAD)
    start = at[base] + k * SPREAD
    return np.searchsorted(w.first, start, side="right") - 1, start, n, a[base]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, d, t, s): a row a segment; s hashes its words."""
    for b in batches:
        d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
        for i, _, data, offsets in pieces(b.column("text")):
            w = Words(data, offsets, PLAIN)
            doc, start, n, anchor = _runs(w)
            if len(doc):
                s = _hash_of(w, start, n, _BASES[0])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(d[doc + i]), pa.array(t[doc + i]), pa.array(s.view(np.int64))], ["anchor", "d", "t", "s"])


def _hash_of(w: Words, at: np.ndarray, n: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of the words of n windows from each position."""
    sums = np.zeros(len(w.hash) + 1, dtype=np.uint64)
    np.cumsum(w.hash * powers(base, len(w.hash)), dtype=np.uint64, out=sums[1:])
    return mix((sums[at + n + WINDOW - 1] - sums[at]) * powers(_inverse(base), len(w.hash) + 1)[at] + n.astype(np.uint64))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, s1, s2, d, t, at, n): segments under shared anchors; s1, s2 hash all their words."""
    for b in batches:
        d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
        shared, hot = b.column("shared"), b.column("hot")
        for i, _, data, offsets in pieces(b.column("text")):
            w = Words(data, offsets, PLAIN)
            doc, start, n, anchor = _runs(w)
            if not len(doc):
                continue
            cut = np.searchsorted(doc, np.arange(len(offsets)))
            keep, single = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
            for k in range(len(offsets) - 1):
                own = anchor[cut[k] : cut[k + 1]].view(np.int64)
                keep[cut[k] : cut[k + 1]] = np.isin(own, shared[i + k].values.to_numpy())
                single[cut[k] : cut[k + 1]] = np.isin(own, hot[i + k].values.to_numpy())
            one = np.flatnonzero(single)
            many = np.flatnonzero(keep & ~single)
            spread = np.repeat(one, n[one])
            at = np.concatenate([start[many], start[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(n[one]) - n[one], n[one])])
            size = np.concatenate([n[many], np.ones(len(spread), np.int64)])
            of = np.concatenate([doc[many], doc[spread]])
            if not len(at):
                continue
            s = [_hash_of(w, at, size, base) for base in _BASES]
            key = np.concatenate([anchor[many], s[0][len(many) :]])
            rows = of + i
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, *s)), pa.array(d[rows]), pa.array(t[rows]), pa.array((at - w.first[of]).astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "s1", "s2", "d", "t", "at", "n"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the segments that stand for all equal ones."""
    for b in batches:
        for i, _, data, offsets in pieces(b.column("text")):
            w = Words(data, offsets, PLAIN)
            rows = [(r, int(w.first[k])) for k in range(len(offsets) - 1) for r in b.column("segs")[i + k].as_py()]
            words = [b" ".join(data[x:y].tobytes() for x, y in zip(w.start[f + r["at"] : f + r["at"] + r["n"] + WINDOW - 1].tolist(), w.end[f + r["at"] : f + r["at"] + r["n"] + WINDOW - 1].tolist(), strict=True)) for r, f in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r, _ in rows], pa.int64()) for c in ("key", "s1", "s2", "d")), pa.array(words, pa.binary())], ["key", "s1", "s2", "d", "words"])


def repeated_windows(pieces_: list[np.ndarray], owner: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each piece, ranges of windows (first, last) that occur in a piece with a smaller owner."""
    length = np.array([len(p) for p in pieces_])
    codes = np.zeros(int(length.sum()) + len(pieces_), dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    for p, s in zip(pieces_, base.tolist(), strict=True):
        codes[s : s + len(p)] = p
    _, rank = np.unique(owner, return_inverse=True)
    index = FMIndex(codes, np.repeat(rank, length + 1), int(length.max()) + 2)
    match = index.matching_statistics(codes, base, base + length, rank, WINDOW)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (match >= WINDOW).astype(np.int8), [0]]))).reshape(-1, 2)  # a match ends with its piece, where a 0 follows
    of = np.searchsorted(base, edge[:, 0], side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in pieces_]
    for k, x, y in zip(of.tolist(), (edge[:, 0] - base[of]).tolist(), (edge[:, 1] - 1 - base[of]).tolist(), strict=True):
        out[k].append((x, y))
    return out


def _shard(table: pa.Table) -> pa.Table:
    words = pc.split_pattern(table.column("words").cast(pa.string()).combine_chunks(), " ")
    flat = words.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64) + 1
    at = words.offsets.to_numpy() - words.offsets.to_numpy()[0]
    found = repeated_windows([codes[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], table.column("d").to_numpy())
    rows = [k for k, f in enumerate(found) if f]
    ranges = pa.array([[{"a": x, "b": y} for x, y in found[k]] for k in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    part = table.select(["key", "s1", "s2"]).take(pa.array(rows, pa.int64()))
    return part.append_column("ranges", ranges)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, sha, runs = [], [], [], []
        for i, _, data, offsets in pieces(b.column("text")):
            w = Words(data, offsets, PLAIN)
            for k in range(len(offsets) - 1):
                first, last = int(w.first[k]), int(w.first[k + 1])
                gone = np.zeros(last - first + 1, dtype=np.int64)
                cell = b.column("gone")[i + k]
                if cell.is_valid:
                    x = cell.values
                    np.add.at(gone, x.field("a").to_numpy(), 1)
                    np.add.at(gone, x.field("b").to_numpy(), -1)
                gone = np.cumsum(gone)[:-1] > 0
                n_words.append(last - first)
                n_removed.append(int(gone.sum()))
                raw, start, end = data[offsets[k] : offsets[k + 1]].tobytes(), w.start[first:last] - offsets[k], w.end[first:last] - offsets[k]
                sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)])).hexdigest())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                runs.append([{"a": int(x), "b": int(y)} for x, y in edge.reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "n_words", "n_removed", "kept_sha256", "runs"])


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, runs (removed words, from and to) of every row; ids are integers.

    A word goes if a window over it also starts in a document with a smaller id. Nulls: a null text has no words; a null id is greater than all others.
    Rows with equal ids do not remove from one another. Texts of fewer words than a window keep all. Empty tables: no rows. Long texts are used whole."""
    small_batches(spark)
    # what is found of documents grows with them: joins with it shuffle at every size
    scratch = Scratch(spark, "substrings")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("t"))
    anchors = scratch.table(rows.select("text", "d", "t").mapInArrow(_anchors, "anchor long, d long, t long, s long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.approx_count_distinct("s").alias("c")).where("lo < hi").select("anchor", (F.col("c") > HOT).alias("hot"))
    shared = scratch.table(shared, "shared")
    lists = anchors.join(bounded(shared, 24), "anchor").groupBy("d", "t").agg(F.collect_set(F.expr("CASE WHEN NOT hot THEN anchor END")).alias("shared"), F.collect_set(F.expr("CASE WHEN hot THEN anchor END")).alias("hot"))  # of one document
    lists = scratch.table(lists, "lists")
    scratch.drop(anchors)
    scratch.drop(shared)
    light = scratch.table(rows.join(lists.hint("merge"), ["d", "t"]).select("text", "d", "t", "shared", "hot").mapInArrow(_segments, "key long, s1 long, s2 long, d long, t long, at int, n int"), "segments")
    scratch.drop(lists)
    alone = light.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("key")
    firsts = light.groupBy("key", "s1", "s2", "n").agg(F.min(F.struct("d", "t", "at")).alias("f")).select("key", "s1", "s2", "n", "f.*")
    alone = scratch.table(alone, "keys")
    firsts = scratch.table(firsts.join(bounded(alone, 16), "key"), "firsts")
    scratch.drop(alone)
    words = firsts.agg(F.coalesce(F.sum(F.col("n") + WINDOW - 1), F.lit(0))).first()[0]
    shards = max(1, -(-words // SHARD_WORDS))
    of = scratch.table(firsts.groupBy("d", "t").agg(F.collect_list(F.struct("key", "s1", "s2", "d", "at", "n")).alias("segs")), "of")
    contents = rows.join(of.hint("merge"), ["d", "t"]).select("text", "segs").mapInArrow(_texts, "key long, s1 long, s2 long, d long, words binary")
    contents = contents.withColumn("shard", F.expr(f"pmod(xxhash64(key), {shards}L)"))
    found = contents.groupBy("shard").applyInArrow(_shard, "key long, s1 long, s2 long, ranges array<struct<a:int,b:int>>")
    found = scratch.table(found.dropDuplicates(["key", "s1", "s2"]), "found")
    scratch.drop(of)
    lo = scratch.table(firsts.select("key", "s1", "s2", F.col("d").alias("lo")).join(found, ["key", "s1", "s2"], "left"), "lo")
    scratch.drop(firsts)
    scratch.drop(found)
    gone = light.join(lo.hint("merge"), ["key", "s1", "s2"]).where("d > lo OR ranges IS NOT NULL")
    gone = gone.select("d", "t", F.expr(f"CASE WHEN d > lo THEN array(named_struct('a', at, 'b', at + n + {WINDOW - 1})) ELSE transform(ranges, r -> named_struct('a', at + r.a, 'b', at + r.b + {WINDOW})) END").alias("g"))
    # of one document: what its repeated rows give is the same, and is held once
    gone = scratch.table(gone.groupBy("d", "t").agg(F.flatten(F.collect_set("g")).alias("gone")), "gone")
    scratch.drop(light)
    scratch.drop(lo)
    return rows.join(gone.hint("merge"), ["d", "t"], "left").select("doc_id", "text", "gone").mapInArrow(_kept, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, runs array<struct<a:long,b:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("runs")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(coalesce(doc_id, 9223372036854775807))),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 50)) AS p FROM win JOIN low USING (h) WHERE coalesce(doc_id, 9223372036854775807) > lo),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN lists USING (r)
"""
