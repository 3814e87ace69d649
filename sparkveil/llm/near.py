"""Near-duplicate documents by Order MinHash (operator 2).

Equal texts are one node. A node's five-word shingles are labelled with their occurrence; for each of BANDS hash orders, the
ORDERED labelled shingles of least hash are taken in the order of the text, and their sequence is a band key. Texts of fewer than SHORT shingles, for which
bands are not sure, also have their rarest shingles as keys: of two similar ones each holds a common one among
its first n - ceil(0.8 n) + 1 in the order of document frequency. Nodes with a common key are candidates.

First each node is aligned with one other, the best-connected of all in its keys, which joins a group of copies of one original in one step. What is left are the
pairs of a key that no verified pairs connect yet. All of them are compared: a task has the shingles of a key's nodes, counts by an inverted
index how many each two have in common, and aligns those that have enough; only the links that join something come out. Keys of very many
shingles are cut into blocks, each two of which meet in a task. The classes are the connected components of the verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, small_batches, unused
from .words import PLAIN, Words, mix, pieces

#: A pair at the threshold has the same ORDERED minima in a band with probability 0.8^6 = 0.26, and in none of 40 bands with (1 - 0.26)^40 = 5e-6.
SHINGLE, SIMILARITY, BANDS, ORDERED = 5, 0.8, 40, 6
#: Pairs whose smaller text has fewer shingles meet by a prefix filter, which loses none; the larger one has up to 5/4 as many.
SHORT = 100
#: Shingles of a block of a key, and of a task.
BLOCK_SHINGLES, TASK_SHINGLES = 1 << 19, 1 << 20
_seeds = np.random.default_rng(11).integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)
_ORDER = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, ORDERED + 1)], dtype=np.uint64)


def labelled_shingles(w: Words) -> list[np.ndarray]:
    """For each text of w: hashes of its five-word shingles with their occurrence, in order. A text of fewer words, but not none, has one shingle, of all its words."""
    g, docs = w.grams(SHINGLE), len(w.offsets) - 1
    count = w.first[1:] - w.first[:-1]
    n = np.maximum(count - SHINGLE + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(w.first[:-1], n)
    h = g[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(docs), n)
    key = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    place = np.arange(len(key))
    run = np.maximum.accumulate(np.where(new, place, 0)) if len(key) else place
    seen = np.empty(len(key), dtype=np.uint64)
    seen[order] = (place - run).astype(np.uint64)
    x = mix(h + seen * np.uint64(0xA24BAED4963EE407))
    out = []
    for d in range(docs):
        if n[d]:
            out.append(x[first[d] : first[d + 1]])
        else:
            all_ = w.hash[w.first[d] : w.first[d + 1]]
            out.append(mix(np.array([sum(int(v) * pow(3, i + 1) for i, v in enumerate(all_)) % 2**64], dtype=np.uint64)) if count[d] else all_[:0])
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """Band keys of a text's labelled shingles."""
    k = min(ORDERED, len(x))
    out = np.zeros(BANDS, dtype=np.uint64)
    step = max(1, (1 << 17) // len(x))
    for a in range(0, BANDS, step):
        y = x[None, :] * _seeds[a : a + step, None]
        y ^= y >> np.uint64(32)
        least = np.argpartition(y, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (len(y), 1))
        least.sort(axis=1)  # the order of the text
        out[a : a + step] = (mix(x[least]) * _ORDER[:k]).sum(axis=1, dtype=np.uint64)
    return mix(out + np.arange(1, BANDS + 1, dtype=np.uint64))


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles matched by the best alignment of a and b in the band that a pair of SIMILARITY can need.

    Labelled shingles are distinct, so each common one is one match (i, j). A pair that is similar enough leaves at most
    (1 - s) / (1 + s) of both sequences unmatched, and no match of its alignment lies further than that off the diagonal."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = 9 * np.abs(i - j) <= len(a) + len(b)  # (1 - s) / (1 + s) = 1/9, in whole numbers
    j = j[near][np.argsort(i[near])]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails = np.zeros(len(j), dtype=np.int64)  # longest increasing run of j
    n = 0
    for v in j.tolist():
        k = int(np.searchsorted(tails[:n], v))
        tails[k] = v
        n = max(n, k + 1)
    return n


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) or not len(a):
        return 0.0
    m = aligned(a, b)
    return m / (len(a) + len(b) - m)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, n, few = [], [], []
        for _, _, data, offsets in pieces(b.column("text")):
            for x in labelled_shingles(Words(data, offsets, PLAIN)):
                n.append(len(x))
                keys.append(sketch(x).view(np.int64) if len(x) else None)
                few.append(x.view(np.int64) if 0 < len(x) and 4 * len(x) < 5 * SHORT else None)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([0 if k is None else BANDS for k in keys])]), pa.int32()), pa.array(np.concatenate([k for k in keys if k is not None]) if any(k is not None for k in keys) else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(n, pa.int32()), flat, pa.array(few, pa.list_(pa.int64()))], ["doc_id", "node", "n", "bands", "few"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for _, _, data, offsets in pieces(b.column("text")):
            out += [x.astype(np.uint32).tobytes() for x in labelled_shingles(Words(data, offsets, PLAIN))]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], ["node", "x"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            ok.append(similarity(*map(np.ascontiguousarray, (_distinct(p), _distinct(q)))) >= SIMILARITY)
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("centre"), mask], ["node", "centre", "ok"])


def _distinct(x: np.ndarray) -> np.ndarray:
    """Labels cut to 32 bits may rarely be equal; the position then tells them apart, as two that match nothing."""
    _, first = np.unique(x, return_index=True)
    if len(first) == len(x):
        return x
    out = x.astype(np.uint64)
    rest = np.ones(len(x), dtype=bool)
    rest[first] = False
    out[rest] = (np.uint64(1) << np.uint64(33)) + np.flatnonzero(rest).astype(np.uint64)
    return out


def _linked(table: pa.Table) -> pa.Table:
    """Pairs (node, centre) of SIMILARITY that join different roots of a unit, aligned; where a unit has nodes of two blocks, pairs of a node of each."""
    unit, block = table.column("unit").to_numpy(), table.column("b").to_numpy()
    node, root = (table.column(c).combine_chunks() for c in ("node", "root"))
    roots = root.dictionary_encode().indices.to_numpy().astype(np.int64)
    texts = table.column("x").combine_chunks()
    order = np.argsort(unit, kind="stable")
    found: list[tuple[int, int]] = []
    for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1) if len(order) else ():
        _, own = np.unique(roots[rows], return_inverse=True)
        if len(rows) < 2 or own.max() == 0:
            continue
        x = [_distinct(np.frombuffer(texts[int(r)].as_buffer(), np.uint32)).astype(np.uint64) for r in rows]
        n = np.array([len(y) for y in x])
        cross = len(np.unique(block[rows])) > 1
        above = list(range(int(own.max()) + 1))  # a forest over the unit's roots

        def top(k: int) -> int:
            while above[k] != k:  # noqa: B023
                above[k] = k = above[above[k]]  # noqa: B023
            return k

        _, which, often = np.unique(np.concatenate(x), return_inverse=True, return_counts=True)
        holders = np.repeat(np.arange(len(x)), n)[np.argsort(which, kind="stable")]
        first, begin = np.cumsum(often) - often, np.concatenate([[0], np.cumsum(n)])
        major = np.bincount(own).argmax()
        for i in np.flatnonzero(own != major).tolist():
            mine = which[begin[i] : begin[i + 1]]
            many = often[mine]
            at = np.repeat(first[mine], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            common = np.bincount(holders[at], minlength=len(x))
            enough = (9 * common >= 4 * (n + n[i])) & (own != own[i])  # what similarity 0.8 needs, whatever the order
            if cross:
                enough &= block[rows] != block[rows[i]]
            near = np.flatnonzero(enough)
            for j in near[np.argsort(-common[near], kind="stable")].tolist():
                if top(own[i]) != top(own[j]) and similarity(x[i], x[j]) >= SIMILARITY:
                    above[top(own[i])] = top(own[j])
                    found.append((int(rows[i]), int(rows[j])))
    i, j = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
    return pa.table({"node": node.take(i), "centre": node.take(j)})


def _verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose alignment is good enough."""
    new = scratch.table(pairs.select(F.least("node", "centre").alias("node"), F.greatest("node", "centre").alias("centre")).distinct(), "candidates")
    got = new.join(texts, "node").join(texts.select(F.col("node").alias("centre"), F.col("x").alias("y")), "centre").select("node", "centre", "x", "y")
    return scratch.table(got.mapInArrow(_verify, "node binary, centre binary, ok boolean").where("ok").select("node", "centre"), "aligned")


def _components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (node, centre): each round gives a node the least root among its neighbours' and its own, and then that root's root, until nothing changes."""
    both = scratch.table(edges.select("node", F.col("centre").alias("other")).union(edges.select(F.col("centre").alias("node"), F.col("node").alias("other"))).distinct(), "both")
    roots = scratch.table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        # written, so that both sides of the next join are shuffled and a root of very many nodes can be split
        step = scratch.table(roots.join(near, "node").select("node", "root", F.least("root", "r").alias("new")), "step")
        # a root that moved takes along the nodes below it
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        moved = scratch.table(step.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("root"), (F.least("new", F.coalesce("up", "new")) != F.col("root")).alias("moved")), "roots")
        scratch.drop(roots, step)
        roots = moved
        if not moved.where("moved").limit(1).count():
            return roots.select("node", "root")


def _prefixes(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(node, key) of the texts with `few`: the first shingles in the order of document frequency, without those of one text alone, as keys."""
    few = nodes.where("few IS NOT NULL").select("node", "n", F.explode("few").alias("t"))
    often = bounded(scratch.table(few.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often"), 24)
    held = few.join(often, "t").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ts"))
    # a text has n - size(ts) shingles of its own alone, which come first and meet nothing
    room = "greatest(0, n - (4 * n + 4) div 5 + 1 - (n - size(ts)))"
    keys = held.select("node", F.explode(F.expr(f"transform(slice(ts, 1, int({room})), s -> xxhash64('few', s.t))")).alias("key"))
    return scratch.table(keys, "prefixes")


def _apart(scratch: Scratch, open_: DataFrame, roots: DataFrame) -> DataFrame:
    """Units (unit, b, node, root, n) in which each two nodes of a key whose roots differ meet. A key with one root has none. A large key is cut into blocks of
    its largest root's nodes and blocks of the others; two blocks of the former need not meet."""
    roots = bounded(scratch.table(roots, "rooted"), 72)
    rooted = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted(open_.select("key", "node", "n")).groupBy("key", "root").agg(F.sum(F.col("n").cast("long")).alias("m"))
    keys = sizes.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("major"), F.max("m").alias("most"), F.sum("m").alias("all_"), F.count(F.lit(1)).alias("d")).where("d > 1")
    keys = keys.select("key", "major", F.expr(f"if(all_ <= {BLOCK_SHINGLES}, 1L, ceil((all_ - most) / {BLOCK_SHINGLES}))").alias("others"), F.expr(f"if(all_ <= {BLOCK_SHINGLES}, 0L, ceil(most / {BLOCK_SHINGLES}))").alias("majors"))
    met = rooted(open_.select("key", "node", "n").join(bounded(scratch.table(keys, "apart"), 72), "key")).withColumn("other", F.expr("majors = 0 OR root != major"))
    met = met.withColumn("b", F.expr("if(other, pmod(xxhash64(node), others), others + pmod(xxhash64(node), greatest(majors, 1L)))"))
    return scratch.table(met.select(F.explode(F.expr("transform(sequence(0L, if(other, others + majors, others) - 1L), o -> xxhash64(key, least(b, o), greatest(b, o)))")).alias("unit"), "b", "node", "root", "n"), "units")


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, class_id, n_links for every row: node is the digest of the text, class_id the least id of the class, n_links the verified links of the text to other texts; links within what others connect already are not looked for.

    Nulls: a row with a null text is alone in a class of its own id; a null id is kept, and is the class id only where the class has no other.
    Empty texts, and texts without words, are classes of equal texts. Texts of fewer than five words are one shingle. Repeated rows have one node and class. Empty tables: no rows. Long texts are used whole."""
    small_batches(spark)
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col))).alias("node"))
    kind = dict(rows.dtypes)["doc_id"]
    made = scratch.table(rows.where("text IS NOT NULL").mapInArrow(_sketches, f"doc_id {kind}, node binary, n int, bands array<long>, few array<long>"), "sketches")
    nodes = scratch.table(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("few").alias("few")), "nodes")
    ids = scratch.table(made.select("doc_id", "node"), "ids")
    scratch.drop(made)

    prefix = _prefixes(scratch, nodes)
    keyed = nodes.select("node", "n", F.explode("bands").alias("key")).union(nodes.select("node", "n").join(prefix, "node").select("node", "n", "key"))
    shared = nodes.select(F.explode("bands").alias("key")).union(prefix.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = bounded(scratch.table(shared, "shared"), 24)
    open_ = scratch.table(keyed.join(shared, "key"), "open")
    wanted = bounded(scratch.table(open_.groupBy("node").agg(F.sum(F.col("c") - 1).alias("w")), "wanted"), 48)
    held = rows.where("text IS NOT NULL").select("node", "text").join(wanted, "node", "left_semi")
    texts = scratch.table(held.mapInArrow(_shingles, "node binary, x binary").dropDuplicates(["node"]), "texts")
    # of the best-connected nodes of a node's keys, the best-connected of a fitting length: an original of many copies for all of them
    centres = open_.join(wanted, "node").groupBy("key").agg(F.max(F.struct("w", "node", F.col("n").alias("m"))).alias("c"))
    centres = bounded(scratch.table(centres, "centres"), 96)
    pairs = open_.select("key", "node", "n").join(centres, "key").where(f"node != c.node AND least(n, c.m) >= {SIMILARITY} * greatest(n, c.m)")
    first = _verified(scratch, pairs.groupBy("node").agg(F.max("c").alias("c")).select("node", F.col("c.node").alias("centre")), texts)
    units = _apart(scratch, open_, _components(scratch, first))
    tasks = max(1, -(-(units.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES))
    met = units.join(texts, "node").withColumn("task", F.expr(f"pmod(xxhash64(unit), {tasks}L)"))
    rest = met.groupBy("task").applyInArrow(_linked, "node binary, centre binary")
    links = scratch.table(first.union(rest).select(F.least("node", "centre").alias("node"), F.greatest("node", "centre").alias("centre")).distinct(), "links")
    roots = _components(scratch, links)
    degree = links.select("node").union(links.select("centre")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of = nodes.select("node", "least").join(roots, "node", "left").join(degree, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    of = scratch.table(of, "of")
    names = of.groupBy("root").agg(F.min("least").alias("class_id"))
    of = bounded(scratch.table(of.join(names, "root").select(F.col("node").alias("n_"), "class_id", "n_links"), "named"), 56)
    out = ids.join(of, F.col("node") == F.col("n_")).select("doc_id", "node", "class_id", "n_links")
    alone = rows.where("text IS NULL").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least id; of repeated rows of that one, one.

    Nulls: rows with a null text all stay; a null id stays where its class has no other. Empty texts are one class. Ties, that is several texts of a class under one
    id, are broken by any one of them. Empty tables give no rows. Long texts are used whole. Other columns are kept as they are, whatever their names."""
    scratch = Scratch(spark, "near-stage")
    found = classes(spark, docs)
    own, node = unused(docs.columns, "own_", "node_")
    told = scratch.table(found.select("doc_id", "node", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays")), "told")
    rows = docs.withColumn(own, F.col("doc_id")).withColumn(node, F.unhex(F.md5("text")))
    same = lambda side: F.col(own).eqNullSafe(side["d"]) & F.col(node).eqNullSafe(side["n"])
    gone = bounded(scratch.table(told.where("NOT stays").select(F.col("doc_id").alias("d"), F.col("node").alias("n")).distinct(), "gone"), 48)
    kept = rows.join(gone, same(gone), "left_anti")
    # one class may hold several texts under the one id that stays, and one text several rows
    many = told.where("stays").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("d"))
    many = bounded(scratch.table(many, "many"), 16)
    if many.limit(1).count():
        (cls,) = unused(kept.columns, "class_")
        held = kept.join(many, F.col(own).eqNullSafe(many["d"]), "left_semi")
        of = told.select(F.col("doc_id").alias("d"), F.col("node").alias("n"), F.col("class_id").alias(cls)).distinct()
        names = held.join(of, same(of)).drop(of["d"], of["n"])
        once = names.where("text IS NOT NULL").dropDuplicates([cls]).select(*docs.columns).unionByName(names.where("text IS NULL").select(*docs.columns))
        kept = kept.join(many, F.col(own).eqNullSafe(many["d"]), "left_anti").select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns)
