"""Benchmark decontamination by a prefix-filtered set join (operator 9).

An item's windows are its runs of 8 words, or all its words if it has fewer. Windows are sets of shingles of 3 words, ordered by rarity,
that is by their count over all documents. A document contains a window only with all its shingles, so that its necessary prefix is the
one rarest shingle. Occurrences of prefix shingles in documents are joined with the table of prefixes; each tells the one place where a window would lie,
places that begin before or end after the document are dropped (position and length bounds), and the words at the others are joined with the windows, word by word.

Benchmark, windows and occurrences are tables, whatever their size. Only a filter of FILTER_BITS bits goes through the driver: it spares
the join the shingles that surely are no prefix, and costs nothing but such shingles where it is too full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, bounded, small_batches
from .words import FOLDED, Words, mix, pieces

WINDOW, SHINGLE, MIN_ITEMS = 8, 3, 2
#: Words of a window from which the pipeline's stage takes a document as contaminated; a shorter whole item alone does not remove one.
STAGE_WORDS = 4
#: Bits of the filter, 2 MB.
FILTER_BITS = 1 << 24
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[0x41:0x5B] += 32
_FOUND = pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("lead", pa.int32()), ("words", pa.list_(pa.string()))]))


def _grams(w: Words, n: int) -> np.ndarray:
    """Hashes of n words, that of n = 1 not the word's own; they run over the ends of texts."""
    return mix(w.grams(n) + np.uint64(n))


def _strings(low: np.ndarray, w: Words, a: int, b: int) -> list[str]:
    return [low[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words, shingles) of the windows of items."""
    for b in batches:
        items, words, shingles = [], [], []
        for i, _, data, offsets in pieces(b.column("text")):
            w = Words(data, offsets, FOLDED)
            low, grams = _LOWER_BYTE[w.data], [_grams(w, n) for n in range(1, SHINGLE + 1)]
            for k in range(len(offsets) - 1):
                first, last = int(w.first[k]), int(w.first[k + 1])
                own = _strings(low, w, first, last)
                n = min(WINDOW, last - first)
                g = grams[min(SHINGLE, n) - 1] if n else None
                for s in range(last - first - n + 1 if n else 0):
                    items.append(b.column("item")[i + k].as_py())
                    words.append(own[s : s + n])
                    shingles.append(g[first + s : first + s + n - min(SHINGLE, n) + 1].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(shingles, pa.list_(pa.int64()))], ["item", "words", "shingles"])


def _filter(spark: SparkSession, hashes: DataFrame):
    """A broadcast bit set of the column h, by its low bits. FILTER_BITS / 64 rows come to the driver at most."""
    bit = F.expr(f"h & {FILTER_BITS - 1}L")
    rows = hashes.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, int(b % 64)))").alias("v")).collect()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[[r["i"] for r in rows]] = [r["v"] for r in rows]
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(64 * len(bits) - 1)
    return np.flatnonzero((bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))


def _join_sized(left: DataFrame, small: DataFrame, cost, on, how: str = "inner") -> DataFrame:
    """The join, small being broadcast if its rows' bytes, as the expression cost counts them, are few; else shuffled."""
    held = small.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    return left.join(F.broadcast(small) if held <= BROADCAST_BYTES else small, on, how)


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, items): the columns `keep` of every document with digest of its text and n_words; (digest, a, b, w) of every occurrence of a window w, from word a to word b; (w, item)."""
    small_batches(spark)
    given = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    made = scratch.table(given.mapInArrow(_windows, "item string, words array<string>, shingles array<long>").withColumn("w", F.expr("unhex(md5(array_join(words, ' ')))")), "windows")
    items = scratch.table(made.select("w", "item").distinct(), "items")
    windows = scratch.table(made.groupBy("w").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles")), "distinct")
    scratch.drop(made)
    shingles = scratch.table(windows.select("w", F.size("words").alias("n"), F.posexplode("shingles").alias("at", "h")), "shingles")
    sizes = sorted(r[0] for r in shingles.select(F.expr(f"least({SHINGLE}, n)")).distinct().collect())
    text = F.coalesce(F.col(text_col), F.lit(""))

    some = _filter(spark, shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in pieces(b.column(0)):
                w = Words(data, offsets, FOLDED)
                for n in sizes:
                    g = _grams(w, n)
                    i = _maybe(some.value, g)
                    h, c = np.unique(g[i[w.within(n)[i]]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    often = scratch.table(docs.select(text.alias("t")).mapInArrow(count, "h long, c long").join(bounded(scratch.table(shingles.select("h").distinct(), "known"), 16), "h", "left_semi").groupBy("h").agg(F.sum("c").alias("c")), "often")
    # a window with a shingle that no document has occurs nowhere; of the others the rarest shingle is the prefix
    rarity = shingles.join(often, "h", "left").groupBy("w").agg(F.min(F.struct("c", "at", "h")).alias("p"), F.first("n").alias("n"), F.bool_or(F.col("c").isNull()).alias("absent"))
    prefix = scratch.table(rarity.where("NOT absent").select("w", "n", "p.at", "p.h"), "prefix")
    places = scratch.table(prefix.select("h", "n", "at").distinct(), "places")
    rare = _filter(spark, places.select("h").distinct())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, rows, found = [], [], []
            for i, _, data, offsets in pieces(b.column("text_")):
                w = Words(data, offsets, FOLDED)
                n_words.append(np.diff(w.first))
                low = None
                for n in sizes:
                    g = _grams(w, n)
                    at = _maybe(rare.value, g)
                    at = at[w.within(n)[at]]
                    if len(at) and low is None:
                        low = _LOWER_BYTE[w.data]
                    of = np.searchsorted(w.first, at, side="right") - 1
                    for p, d, h in zip(at.tolist(), of.tolist(), g[at].view(np.int64).tolist(), strict=True):
                        first, last = int(w.first[d]), int(w.first[d + 1])
                        a = max(first, p - WINDOW + 1)
                        rows.append(i + d)
                        found.append({"pos": p - first, "h": h, "lead": p - a, "words": _strings(low, w, a, min(last, p + WINDOW))})
            order = np.argsort(rows, kind="stable") if rows else []
            cut = np.searchsorted(np.asarray(rows, dtype=np.int64)[order], np.arange(b.num_rows + 1)) if rows else np.zeros(b.num_rows + 1, np.int64)
            flat = pa.array([found[k] for k in order], _FOUND.value_type)
            kept = [(n, b.column(n)) for n in b.schema.names if n != "text_"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat)], [n for n, _ in kept] + ["n_words", "found"])

    taken = docs.select(*keep, F.unhex(F.md5(text)).alias("digest"), text.alias("text_"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema if f.name != "text_"] + ["n_words long, found array<struct<pos:int,h:long,lead:int,words:array<string>>>"])
    rows = scratch.table(taken.mapInArrow(find, schema), "rows")
    seen = rows.where("size(found) > 0").select("digest", "n_words", F.explode("found").alias("f")).select("digest", "n_words", "f.*").join(bounded(places, 32), "h")
    seen = seen.where("at <= lead AND pos - at + n <= n_words").selectExpr("digest", "pos - at AS a", "pos - at + n AS b", "slice(words, lead - at + 1, n) AS words")
    seen = seen.withColumn("w", F.expr("unhex(md5(array_join(words, ' ')))"))
    exact = _join_sized(seen.alias("s"), windows.join(prefix.select("w"), "w", "left_semi").select("w", "words").alias("x"), F.expr("64 + 24 * size(words)"), F.expr("s.w = x.w AND s.words = x.words"))
    return rows, scratch.table(exact.select("digest", "a", "b", "s.w").distinct(), "hits"), items


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs of every document; runs are the hit words, from and to.

    Nulls: a null text has no words and no hits; items with a null id or text, or without words, have no windows; a null
    doc_id is kept. Equal items are items of their own; equal ids are one item. Repeated rows are reported each. Empty tables: no documents, no rows; no items, no hits.
    Long texts are scanned whole; other columns are not read."""
    scratch = Scratch(spark, "decontaminate")
    rows, found, items = hits(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, scratch, keep=("doc_id",))
    # runs of hit words: a place that no earlier one of the text reaches begins one
    reach = found.select("digest", "a", "b").distinct().withColumn("far", F.expr("max(b) OVER (PARTITION BY digest ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    run = reach.withColumn("run", F.expr("sum(CASE WHEN far >= a THEN 0 ELSE 1 END) OVER (PARTITION BY digest ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    run = run.groupBy("digest", "run").agg(F.min("a").cast("long").alias("a"), F.max("b").cast("long").alias("b")).groupBy("digest").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    own = found.select("digest", "w").distinct().join(items, "w").groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("its"))
    got = own.select("digest", F.size("its").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "its"), 256).alias("sha")).join(run, "digest")
    got = scratch.table(got.withColumnRenamed("digest", "g_"), "got")
    out = _join_sized(rows.drop("found"), got, F.expr("200 + 40 * size(runs)"), F.col("digest") == F.col("g_"), "left")
    none = F.expr("cast(array() AS array<struct<a:bigint,b:bigint>>)")
    n = F.coalesce("n_items", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n.alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n >= MIN_ITEMS).alias("contaminated"), F.coalesce("runs", none).alias("runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("runs")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """The rows of docs whose text holds no window, of at least `words` words, of any item; all columns as they are.

    Nulls: a null text holds none and stays. Equal texts, also of repeated rows, stay or go together. Empty tables: no documents, no rows; no
    items, all rows. Other columns are not read, whatever their names. Long texts are scanned whole."""
    scratch = Scratch(spark, "clean")
    _, found, _ = hits(spark, docs.select("text"), benchmark, scratch)
    gone = scratch.table(found.where(F.col("b") - F.col("a") >= words).select("digest").distinct(), "gone")
    return docs.join(bounded(gone, 48), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))) == gone["digest"], "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: clean() with the benchmark table."""
    return clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT i, least(8, len(w)) AS n, list_slice(w, s, s + least(8, len(w)) - 1) AS g FROM (SELECT i, w, unnest(range(1, greatest(2, len(w) - 6))) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT r, s, o.n, i FROM occ o JOIN win USING (g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(DISTINCT i) AS n_items, string_agg(DISTINCT i, ',' ORDER BY i) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
