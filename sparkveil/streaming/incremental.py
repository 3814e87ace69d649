"""Texts that arrive over time: each micro-batch continues the vault of those before it.

Numbers follow arrival: batches in their order, and doc_seq within a batch, as if all had come in one table in that order. One
query writes a vault; its tables are versions by batch id, so that a batch that is run again after a failure starts from the
same version and writes the same one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.engine import Engine
from ..vault import TABLES


class VaultVersions:
    """The vault's tables under a shared folder, one version a batch. They hold originals: the folder needs the protection of a vault."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, version: int, table: str) -> str:
        return f"{self.root}/v{version:010d}/{table}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def before(self, version: int) -> dict[str, DataFrame] | None:
        """The latest complete version before this one."""
        for v in range(version - 1, -1, -1):
            if self._exists(f"{self._path(v, 'stems')}/_SUCCESS"):
                return {t: self.spark.read.schema(s).parquet(self._path(v, t)) for t, s in TABLES.items() if t != "originals"}
        return None

    def write(self, version: int, tables: dict[str, DataFrame]) -> None:
        for name in ("keys", "counters", "variants", "stems"):  # the last one marks the version as complete
            tables[name].write.mode("overwrite").parquet(self._path(version, name))


def anonymize_stream(engine: Engine, units: DataFrame, versions: VaultVersions, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query over a stream of units (doc_seq, unit_seq, text); sink gets each batch's units with tokens, and its id, and writes them before it returns."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        run = engine.anonymize(batch, "reversible", versions.before(batch_id))
        sink(run.units, batch_id)
        versions.write(batch_id, run.vault)
        run.discard()

    return units.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
