"""Shared tables, size-checked joins and distributed ranks for the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, by estimated bytes, that is sent to every executor. Larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
ARROW_BYTES = 8 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sparkveil-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES at most for what follows, where the session has Spark's own limit: texts are long, and a worker holds a
    batch more than once. A limit that somebody has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(name, "67108864b")).rstrip("b") in ("67108864", "64m"):
        spark.conf.set(name, f"{ARROW_BYTES}b")


class Scratch:
    """Tables in the shared folder that cut the lineage. drop() removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}-{self.n}"
        self.n += 1
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column of a table has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small, a written table, with the broadcast hint if its counted rows stay below the limit; else as it is, for a shuffled join."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def copies(scratch: Scratch, rows: DataFrame, row: str, by: list[str], name: str) -> DataFrame:
    """rows with `name`, a row's number among those that are equal in the columns `by`, from 0. Rows is a written table, `row` its monotonically
    increasing number. Of equal rows it does not matter which has which number, so that what is drawn from it does not depend on how rows are laid out.
    No task holds a group: copies are counted by partition first."""
    kept = rows.select(row, F.xxhash64(*by).alias("h"))
    many = scratch.table(kept.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "many")
    if not many.limit(1).count():
        return rows.withColumn(name, F.lit(0).cast("long"))
    twins = kept.join(bounded(many, 16), "h").withColumn("part", F.shiftright(F.col(row), 33))
    starts = twins.groupBy("h", "part").agg(F.count(F.lit(1)).alias("n")).select("h", "part", F.expr("coalesce(sum(n) OVER (PARTITION BY h ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("n0"))
    placed = twins.withColumn("k", F.expr(f"row_number() OVER (PARTITION BY h, part ORDER BY `{row}`) - 1")).join(bounded(scratch.table(starts, "starts"), 40), ["h", "part"])
    numbers = bounded(scratch.table(placed.select(F.col(row).alias("r"), (F.col("n0") + F.col("k")).cast("long").alias(name)), "copies"), 32)
    return rows.join(numbers, F.col(row) == F.col("r"), "left").select(*rows.columns, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def rank_in_group(spark: SparkSession, df: DataFrame, group: list[str], unit: str, order: list[str], n_rows: int, weight: str | None = None, per_bucket: int = 65536, least: int = 64) -> DataFrame:
    """Adds `rank_`, the 0-based rank of each row within its group by `unit` (a double from 0 to 1, evenly spread) and then `order`;
    with `weight`, `before_` too, the sum of weight over the rows that come earlier. No task holds a group: rows are dealt by
    (group, slice of unit), slices are counted first, and what precedes a slice is added to what precedes a row within it.
    The slices grow with n_rows, so that one has about per_bucket rows at most if a group had them all."""
    slices = max(least, -(-n_rows // per_bucket))
    dealt = df.withColumn("slice_", F.least(F.floor(F.col(unit) * slices), F.lit(slices - 1)).cast("int"))
    keys = [*group, "slice_"]
    sums = [F.count(F.lit(1)).alias("n_")] + ([F.sum(weight).alias("w_")] if weight else [])
    up_to = f"({', '.join(f'`{g}`' for g in group)})"
    over = f"OVER (PARTITION BY {up_to[1:-1]} ORDER BY slice_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = dealt.groupBy(*keys).agg(*sums).select(*keys, F.expr(f"coalesce(sum(n_) {over}, 0L)").alias("n0_"), *([F.expr(f"coalesce(sum(w_) {over}, 0L)").alias("w0_")] if weight else []))
    starts = bounded(Scratch(spark, "slices").table(starts, "starts"), 48)
    inner = f"PARTITION BY {up_to[1:-1]}, slice_ ORDER BY {', '.join(f'`{o}`' for o in [unit, *order])}"
    joined = dealt.select("*", F.expr(f"row_number() OVER ({inner}) - 1").alias("r_"), *([F.expr(f"coalesce(sum(`{weight}`) OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("b_")] if weight else []))
    s = starts.select(*[F.col(k).alias(f"s_{k}") for k in keys], "n0_", *(["w0_"] if weight else []))
    out = joined.join(s, F.expr(" AND ".join(f"`{k}` <=> `s_{k}`" for k in keys)))
    return out.select(*df.columns, (F.col("n0_") + F.col("r_")).cast("long").alias("rank_"), *([(F.col("w0_") + F.col("b_")).cast("long").alias("before_")] if weight else []))
