"""Sharding by a hierarchical weighted hash tree (operator 8, DataFrame functions only).

A topology is regions, each of racks, each of (shard, weight). A key descends region, rack and shard: at each level every
child draws -ln(u) / weight, u being a hash of the key and of the child's path, and the least draw wins. A child's draw depends
on nothing but the key, its path and its own weight, so a changed weight moves keys between that child and its
siblings only, and a changed subtree moves keys only into it or out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, copies, rank_in_group, unused

Topology = dict[str, dict[str, list[tuple[int, float]]]]
#: Shards to a rack and racks to a region of the regular part of a topology.
RACK, REGION = 4, 2


def topology(shards: int, base: int = 16) -> Topology:
    """`base` shards in regular racks and regions; each later shard is mounted as a region of its own, so that growing by one
    leaves every existing subtree's weight as it was and keys move only into the new shard."""
    tree: Topology = {}
    for s in range(min(shards, base)):
        rack = s // RACK
        tree.setdefault(f"g{rack // REGION}", {}).setdefault(f"r{rack % REGION}", []).append((s, 1.0))
    for s in range(base, shards):
        tree[f"g{-(-base // (RACK * REGION)) + s - base}"] = {"r0": [(s, 1.0)]}
    return tree


def uniform(text: Column | str) -> Column:
    """A double in (0, 1) from the first 52 bits of an MD5, so that other engines can draw the same."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _level(key: Column, table: dict[str, list[tuple[str, float]]], path: Column) -> Column:
    """The path of the winning child below `path`."""
    rows = [F.struct(F.lit(p), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in kids])) for p, kids in table.items()]
    kids = F.element_at(F.map_from_entries(F.array(*rows)), path)
    draws = F.transform(kids, lambda x: F.struct((-F.ln(uniform(F.concat_ws("|", key, x["c"]))) / x["w"]).alias("d"), x["c"].alias("c")))
    return F.array_min(draws)["c"]


def draw_shard(key: Column, tree: Topology) -> Column:
    """The shard of a key. Weights of racks and regions are the sums of their shards'; children of weight 0 or less take nothing."""
    weight = lambda shards: sum(w for _, w in shards if w > 0)
    regions = {"": [(g, sum(map(weight, racks.values()))) for g, racks in tree.items()]}
    racks = {g: [(f"{g}/{r}", weight(s)) for r, s in x.items()] for g, x in tree.items()}
    leaves = {f"{g}/{r}": [(f"{g}/{r}/{s}", w) for s, w in shards] for g, x in tree.items() for r, shards in x.items()}
    out = F.lit("")
    for table in (regions, racks, leaves):
        out = _level(key, {p: kept for p, kids in table.items() if (kept := [k for k in kids if k[1] > 0])}, out)
    return F.element_at(F.split(out, "/"), -1).cast("int")


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard for every row.

    The law is `key`: the id and the number of shards decide. slot runs from 0 without gaps in each shard, by a hash of id, size, CRC and the row's
    number among those equal in all three, so that neither a repeated nor a null id lands in one task. Nulls: a null text has no bytes; a null id is drawn as the word null. Repeated rows stay, in the
    same shard and in slots of their own. An empty table gives no rows. Columns other than id and text are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("b"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    scratch = Scratch(spark, "shards")
    rows = scratch.table(rows.select("doc_id", (F.col("b") + 1).alias("size"), "text_crc32", F.monotonically_increasing_id().alias("row_")), "rows")
    rows = copies(scratch, rows, "row_", ["doc_id", "size", "text_crc32"], "copy_")
    slot = uniform(F.concat_ws("|", F.lit("slot"), key, F.col("size"), F.col("text_crc32"), F.col("copy_")))
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), draw_shard(key, topology(shards)).alias("shard"), draw_shard(key, topology(shards + 1)).alias("grown_shard"), slot.alias("u_"), "copy_")
    ranked = rank_in_group(spark, rows, ["shard"], "u_", ["doc_id", "size", "text_crc32", "copy_"], docs.count())
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("rank_").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with the shard that their id draws. The last stage, so a column is added, with underscores if docs has its name.

    Nulls: a null id is drawn as the word null; a null text is kept. Repeated ids are in one shard. Empty tables give no rows. Texts are not read."""
    (name,) = unused(docs.columns, "shard")
    return docs.withColumn(name, draw_shard(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), topology(16)))


def _sql_draw(n: int) -> str:
    tree = topology(n)
    u = lambda x: f"((('0x' || substr(md5(k || '|' || {x}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"

    def least(kids: list[tuple[str, float]]) -> str:
        return "list_min([" + ", ".join(f"struct_pack(d := -ln({u(repr(c))}) / {w:.1f}, c := {c!r})" for c, w in kids) + "]).c"

    region = least([(g, float(sum(w for s in x.values() for _, w in s))) for g, x in tree.items()])
    rack = "CASE g " + " ".join(f"WHEN {g!r} THEN {least([(f'{g}/{r}', float(sum(w for _, w in s))) for r, s in x.items()])}" for g, x in tree.items()) + " END"
    leaf = "CASE r " + " ".join(f"WHEN '{g}/{r}' THEN {least([(f'{g}/{r}/{s}', w) for s, w in shards])}" for g, x in tree.items() for r, shards in x.items()) + " END"
    return f"SELECT k, split_part({leaf}, '/', 3)::INT AS shard FROM (SELECT k, {rack} AS r FROM (SELECT k, {region} AS g FROM keys))"


ORACLE = f"""
WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
a AS ({_sql_draw(16)}), b AS ({_sql_draw(17)}),
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END, i) AS c FROM range(0, 256) r(i))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, k, octet_length(encode(x))::BIGINT + 1 AS size,
  xor(4294967295::BIGINT, list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY {"((('0x' || substr(md5('slot|' || k || '|' || size || '|' || text_crc32 || '|' || copy), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"}, doc_id, size, text_crc32, copy) - 1 AS slot, b.shard AS grown_shard
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM crc) JOIN a USING (k) JOIN b USING (k)
"""
