"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 1, DataFrame functions only).

Documents are blocks; those of more words than a block are cut into several. A source's quota is the exact number of blocks that reaches its target:
whole passes over its blocks and a part of one more pass, the last block in part. The quotas are split among the output shards by a binary tree: at each
node the left half's counts are a multivariate hypergeometric draw from those of the node, made by halving the sources as well: how many blocks of the first half of the
sources go left, then of each quarter, and so on. Each source's blocks are permuted by a hash, and a shard draws the run of ranks that its quota
gives it, so that shards never share a block; what no shard draws is not in the mix. Within a shard, blocks are shuffled by another hash.

All draws hash a row's contents and its number among equal rows, never where it lies, so that the mix is the same however the table is laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, copies, rank_in_group, unused

#: Production parameters: weights repeat over the sources by code point; words of all targets as hundredths of all words.
WEIGHTS, SHARE_PERCENT, CEILING, BLOCK_WORDS, SHARDS, SEED = (3, 1, 2), 150, 2, 2048, 16, 7
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column | str) -> Column:
    """A double from 0 to 1 (exclusive) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11).cast("double") / float(2**53)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, ceiling: int = CEILING) -> DataFrame:
    """source, source_size, target from (source, size). One row a source, null last.

    A target stops at ceiling x its source's size; what is left is shared anew by weight. That ends where the sources with
    the least ceiling per weight are at their ceiling and the others get one amount per weight, found here by running sums."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = "element_at(array(" + ",".join(map(str, weights)) + f"), cast(pmod(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1, {len(weights)}) + 1 AS int))"
    per = per.select("source", "source_size", F.expr(w).cast("long").alias("w"), F.expr(f"{ceiling} * source_size").alias("cap"))
    by = "OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    per = per.select("*", F.expr("sum(source_size) OVER ()").alias("all_"), F.expr("sum(w) OVER ()").alias("w_all"), F.expr(f"coalesce(sum(cap) {by}, 0L)").alias("cap0"), F.expr(f"coalesce(sum(w) {by}, 0L)").alias("w0"))
    # 100 x what is left for the sources from this one on; the first that is not above its ceiling sets the level for all after it
    per = per.withColumn("left_", F.expr(f"{percent} * all_ - 100 * cap0")).withColumn("free", F.expr("left_ * w <= 100 * cap * (w_all - w0)"))
    per = per.withColumn("at", F.expr("min(CASE WHEN free THEN struct(cap / w AS r, left_, w_all - w0 AS ws) END) OVER ()"))
    return per.select("source", "source_size", F.expr("CASE WHEN free THEN cast(w * at.left_ AS double) / cast(100 * at.ws AS double) ELSE cast(cap AS double) END").alias("target"))


def _log_factorial(n: str) -> str:
    """SQL for ln n!, by Stirling's series from 8 on and by the product below."""
    m = f"cast({n} AS double)"
    tail = f"(({m} + 0.5) * ln({m}) - {m} + 0.9189385332046727 + 1 / (12 * {m}) - 1 / (360 * {m} * {m} * {m}) + 1 / (1260 * {m} * {m} * {m} * {m} * {m}))"
    return f"CASE WHEN {n} < 8 THEN element_at(array(0.0D, 0.0D, 0.6931471805599453D, 1.791759469228055D, 3.1780538303479458D, 4.787491742782046D, 6.579251212010101D, 8.525161361065415D), cast({n} AS int) + 1) ELSE {tail} END"


def _hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for a draw: of `total` blocks, `good` of one kind, `drawn` go left; the smallest k whose distribution function reaches u.

    Only k within 10 standard deviations and 12 of the mean are summed; what lies beyond is less than the precision of a double. The first probability comes
    from logarithms of factorials, each later one from the one before."""
    lo, hi = f"greatest(0L, {drawn} + {good} - {total})", f"least({good}, {drawn})"
    mean = f"({drawn} * cast({good} AS double) / greatest({total}, 1L))"
    wide = f"(12 + 10 * sqrt({mean} * (1 - {good} / cast(greatest({total}, 1L) AS double)) + 1))"
    a, b = f"greatest({lo}, cast(floor({mean} - {wide}) AS bigint))", f"least({hi}, cast(ceil({mean} + {wide}) AS bigint))"
    logs = f"transform(array({good}, a0, {good} - a0, {total} - {good}, {drawn} - a0, {total} - {good} - {drawn} + a0, {total}, {drawn}, {total} - {drawn}), n -> {_log_factorial('n')})"
    p0 = f"transform(array({logs}), l -> exp(l[0] - l[1] - l[2] + l[3] - l[4] - l[5] - l[6] + l[7] + l[8]))[0]"
    ratio = f"cast({good} - k AS double) * ({drawn} - k) / (cast(k + 1 AS double) * ({total} - {good} - {drawn} + k + 1))"
    step = f"CASE WHEN z.done THEN z WHEN z.f + z.p >= {u} THEN named_struct('f', z.f, 'p', z.p, 'k', k, 'done', true) ELSE named_struct('f', z.f + z.p, 'p', z.p * {ratio}, 'k', z.k, 'done', false) END"
    return f"transform(array({a}), a0 -> aggregate(sequence(a0, {b}), named_struct('f', 0.0D, 'p', {p0}, 'k', {b}, 'done', false), (z, k) -> {step}, z -> z.k))[0]"


def _halved(levels: int, u: str) -> str:
    """SQL for the running numbers of blocks that go left: entry j is the number from the first j sources, of 2^levels. `pre` has the running numbers of all blocks,
    m is how many go left. From (0, m), each level draws the entries midway between those known."""
    out = "array(0L, m)"
    for k in range(levels):
        step = 1 << (levels - k)
        lo, mid, hi = f"pre[j * {step}]", f"pre[j * {step} + {step // 2}]", f"pre[(j + 1) * {step}]"
        draw = _hypergeometric("h.t", "h.g", "h.d", "h.u")
        one = f"array(a[j], a[j] + transform(array(named_struct('t', {hi} - {lo}, 'g', {mid} - {lo}, 'd', a[j + 1] - a[j], 'u', {u.format(key=f'{k}, j')})), h -> {draw})[0])"
        out = f"transform(array({out}), a -> concat(flatten(transform(sequence(0, {(1 << k) - 1}), j -> {one})), array(m)))[0]"
    return out


def split_quotas(drawn: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """source, shard, first, quota from (source, blocks), a written table: the splitting tree. Quotas of a source add up to its blocks; those of a
    shard to all blocks / shards, give or take one. A row is a node, with one number a source; blocks are not touched."""
    by = drawn.select("source", "blocks", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST) - 1").alias("i"), F.expr("sum(blocks) OVER (ORDER BY source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)").alias("until"))
    count = drawn.count()
    levels = max(0, count - 1).bit_length()
    # running numbers, filled up to a power of two of sources by empty ones
    nodes = by.agg(F.array_sort(F.collect_list("until")).alias("u")).where("size(u) > 0").select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.expr(f"concat(array(0L), u, array_repeat(u[size(u) - 1], {(1 << levels) - count}))").alias("pre"))
    u = f"(shiftrightunsigned(xxhash64({seed}, lo, hi, {{key}}), 11) / 9007199254740992D)"
    wide = shards
    while wide > 1:
        # the node's blocks go to its shards as evenly as can be: the left shards' part
        nodes = nodes.withColumn("mid", F.expr("lo + (hi - lo + 1) div 2")).withColumn("m", F.expr(f"(pre[{1 << levels}] * (mid - lo)) div (hi - lo)"))
        nodes = nodes.withColumn("ks", F.expr(f"CASE WHEN hi - lo > 1 THEN {_halved(levels, u)} ELSE pre END"))
        left, right = "named_struct('lo', lo, 'hi', mid, 'pre', ks)", "named_struct('lo', mid, 'hi', hi, 'pre', transform(pre, (p, i) -> p - ks[i]))"
        nodes = nodes.select(F.expr(f"explode(CASE WHEN hi - lo > 1 THEN array({left}, {right}) ELSE array(named_struct('lo', lo, 'hi', hi, 'pre', pre)) END) AS x")).select("x.*")
        wide = -(-wide // 2)
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode(F.expr("transform(slice(pre, 2, size(pre) - 1), (p, i) -> p - pre[i])")).alias("i", "quota"))
    leaves = leaves.withColumn("first", F.expr("coalesce(sum(quota) OVER (PARTITION BY i ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    return leaves.where("quota > 0").join(by.select("i", "source"), "i").select("source", "shard", "first", "quota")


def plan(spark: SparkSession, docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, blocks). rows: row_, doc_id, source, size; sources: targets; blocks: row_, doc_id, source, size, pass, block, start,
    words, taken, shard, order_: every block of every pass. taken are the words from its front that the mix takes, if a shard draws it; by order_ a shard's blocks are shuffled.

    `also` are further columns whose contents tell rows apart; `row` is a column of docs with their physical numbers, if docs is a written table that has one."""
    scratch = Scratch(spark, "mixing")
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, source_col, text_col, *(also or [])).alias("d_"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row_"))
    rows = scratch.table(numbered, "rows")  # a number is only ever read back from a table
    sources = scratch.table(targets(rows), "sources")
    side = bounded(sources.select(F.col("source").alias("s_"), "source_size", "target"), 64)
    blocks = copies(scratch, rows, "row_", ["d_"], "copy_").join(side, F.col("source").eqNullSafe(F.col("s_"))).where("size > 0 AND target > 0").selectExpr("row_", "doc_id", "source", "size", "d_", "copy_", "source_size", "target", "explode(sequence(0, cast(ceil(target / source_size) AS int) - 1)) AS pass")
    blocks = blocks.selectExpr("*", f"explode(sequence(0L, (size - 1) div {BLOCK_WORDS})) AS block").selectExpr("*", f"block * {BLOCK_WORDS} AS start", f"least({BLOCK_WORDS}L, size - block * {BLOCK_WORDS}) AS words")
    blocks = blocks.withColumn("u_", unit("d_", "copy_", "block", "pass")).withColumn("order_", F.xxhash64(F.lit(SEED + 1), "d_", "copy_", "block", "pass"))
    n = rows.count()
    blocks = rank_in_group(spark, blocks, ["source", "pass"], "u_", ["d_", "copy_", "block"], 2 * n, "words")
    # a pass before this one has taken the whole source; the target is met to the word
    blocks = blocks.withColumn("due", F.expr("cast(round(target) AS bigint) - pass * source_size - before_"))
    blocks = scratch.table(blocks.select("row_", "doc_id", "source", "size", "pass", "block", "start", "words", "due", "rank_", "order_"), "blocks")
    # exact quotas: the blocks that the target needs; ranks of a later pass follow those of the earlier ones
    drawn = blocks.where("due > 0").groupBy("source", "pass").agg(F.count(F.lit(1)).alias("blocks"))
    drawn = scratch.table(drawn.selectExpr("*", "coalesce(sum(blocks) OVER (PARTITION BY source ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS earlier"), "drawn")
    quotas = split_quotas(scratch.table(drawn.groupBy("source").agg(F.sum("blocks").alias("blocks")), "quotas"))
    runs = quotas.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.expr("first + quota").alias("until"), "shard"))).alias("runs"))
    runs = scratch.table(drawn.select(F.col("source").alias("s_"), F.col("pass").alias("p_"), "earlier").join(runs.withColumnRenamed("source", "r_"), F.col("s_").eqNullSafe(F.col("r_"))).drop("r_"), "runs")
    blocks = blocks.join(bounded(runs, 64 + 16 * SHARDS), F.col("source").eqNullSafe(F.col("s_")) & (F.col("pass") == F.col("p_")), "left")
    blocks = blocks.withColumn("shard", F.expr("get(filter(runs, r -> r.until > earlier + rank_), 0).shard"))
    return rows, sources, blocks.select("row_", "doc_id", "source", "size", "pass", "block", "start", "words", F.expr("CASE WHEN shard IS NULL THEN 0L ELSE least(words, due) END").alias("taken"), "shard", "order_")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws of every document; draws are the blocks drawn, as shard, place in the shard's shuffle, first word and words.

    Nulls: a null text has no words; a null source is a source of its own, last in order; a null id is hashed as null. Documents without
    words take none. Repeated rows are rows of their own, each with draws of its own; which of them has which is not told apart. A source without words has target 0. Empty tables give no rows."""
    rows, sources, blocks = plan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = blocks.where("taken > 0").groupBy("row_").agg(F.sum("taken").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", F.col("order_").alias("place"), "start", F.col("taken").alias("words")))).alias("draws"))
    side = bounded(sources.select(F.col("source").alias("s_"), "source_size", "target"), 64)
    out = rows.join(side, F.col("source").eqNullSafe(F.col("s_"))).join(got, "row_", "left")
    none = F.expr("cast(array() AS array<struct<shard:int,place:bigint,start:bigint,words:bigint>>)")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("draws", none).alias("draws"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed documents, with the columns of docs. A document that the mix takes whole is returned as it is, one that it
    takes twice two times, one that it takes in part as the words taken of each pass, joined by spaces, with n_chars counted anew. Rows are laid out by
    shard, and shuffled within it.

    Nulls: a null text, like one without words, is not in the mix; a null source is a source of its own; null ids are kept. Repeated rows are rows of their own. Rows are told apart by all
    columns, so that the same table gives the same rows however it is laid out. Empty tables give no rows. Columns may have any names. Long texts are split once."""
    row, got, parts, size, shard, place = unused(docs.columns, "row_", "got_", "parts_", "size_", "shard_", "place_")
    numbered = Scratch(spark, "mixed").table(docs.withColumn(row, F.monotonically_increasing_id()), "docs", "snappy")
    also = [f.name for f in docs.schema if f.name not in ("doc_id", "source", "text") and "map<" not in f.dataType.simpleString()]
    _, _, blocks = plan(spark, numbered, also=also, row=row)
    own = blocks.where("taken > 0").groupBy(F.col("row_").alias(row), "pass").agg(F.sum("taken").alias(got), F.array_sort(F.collect_list(F.struct("start", "taken"))).alias(parts), F.first("size").alias(size), F.min(F.struct("shard", "order_")).alias("at"))
    own = own.select(row, got, parts, size, F.col("at.shard").alias(shard), F.col("at.order_").alias(place))
    out = numbered.join(own, row)
    whole = f"`{got}` = `{size}`"
    # the words are one lambda variable, so that a text is split once
    cut = f"transform(array(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), ws -> array_join(flatten(transform(`{parts}`, p -> slice(ws, cast(p.start AS int) + 1, cast(p.taken AS int)))), ' '))[0]"
    out = out.withColumn("text", F.expr(f"CASE WHEN {whole} THEN text ELSE {cut} END"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr(f"CASE WHEN {whole} THEN n_chars ELSE length(text) END").cast(docs.schema["n_chars"].dataType))
    # a shard is dealt in slices of its shuffle, more of them the larger it is
    slices = max(64, numbered.count() // (SHARDS * 4096))
    return out.repartition(shard, F.expr(f"pmod(`{place}`, {slices}L)")).sortWithinPartitions(shard, place).select(*docs.columns)
