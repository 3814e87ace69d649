"""Written intermediate tables, size-checked joins and distributed numbering."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a side that is broadcast.
BROADCAST_BYTES = 32 << 20
_local: dict[str, str] = {}
_folder: ContextVar[str] = ContextVar("folder", default="veil")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where a local session has none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="veil-")
        atexit.register(shutil.rmtree, _local[app], True)
    return f"file://{_local[app]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_folder.get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def apart() -> Iterator[str]:
    """A folder of their own for the tables written within; discard() removes them."""
    folder = f"{_folder.get()}/run-{uuid.uuid4().hex}"
    before = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(before)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes the tables of a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table with the broadcast hint if its counted rows are within the limit; else the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def numbered(df: DataFrame, group: list[str], by: str, order: list[str], name: str, slices: int = 64) -> DataFrame:
    """Adds `name`, 1, 2, .. in each group by `by` (a number) and then `order`. Rows are dealt by group and range of `by`; ranges are counted
    first, so that a large group is numbered by many tasks."""
    df = written(df, "unnumbered")
    cuts = sorted(set(df.approxQuantile(by, [i / slices for i in range(1, slices)], 0.002))) if df.limit(1).count() else []
    at = F.expr(f"size(filter(array({','.join(map(repr, cuts)) or 'cast(null AS double)'}), c -> `{by}` > c))")
    df = df.withColumn("slice_", at)
    keys = ", ".join(f"`{g}`" for g in group)
    starts = df.groupBy(*group, "slice_").agg(F.count(F.lit(1)).alias("n_")).select(*group, "slice_", F.expr(f"coalesce(sum(n_) OVER (PARTITION BY {keys} ORDER BY slice_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("before_"))
    inner = F.expr(f"row_number() OVER (PARTITION BY {keys}, slice_ ORDER BY {', '.join(f'`{o}`' for o in [by, *order])})")
    return df.withColumn("row_", inner).join(starts, [*group, "slice_"]).withColumn(name, (F.col("before_") + F.col("row_")).cast("long")).drop("slice_", "row_", "before_")


def ordered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds `name`, 0, 1, .. in the order of `by`. Rows are dealt by ranges; what precedes a range is added to a row's place in it."""
    df = written(df.repartitionByRange(*by).withColumn("range_", F.spark_partition_id()), "ordered")
    starts = df.groupBy("range_").agg(F.count(F.lit(1)).alias("n_")).select("range_", F.expr("coalesce(sum(n_) OVER (ORDER BY range_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("before_"))
    inner = F.expr(f"row_number() OVER (PARTITION BY range_ ORDER BY {', '.join(f'`{b}`' for b in by)}) - 1")
    placed = df.withColumn("row_", inner).join(F.broadcast(starts), "range_")  # a row a partition
    return placed.withColumn(name, (F.col("before_") + F.col("row_")).cast("long")).drop("range_", "row_", "before_")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt to all of them: matching costs far more than moving a few small files. Larger scans, and
    what has been shuffled already, stay as they are."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
