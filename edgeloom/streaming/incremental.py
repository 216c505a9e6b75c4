"""Connected components kept up to date under insertion of edges.

Inserting edges only ever merges components, so a batch needs the current labels of its own ends, not the old edges:
relabel the batch, solve it, and compose the result onto the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom.operators import joins
from edgeloom.plans.components import connected_components


def absorb(labels: DataFrame, batch: DataFrame, representative: str = "max") -> DataFrame:
    """The labels after a batch of edges ``(u, v)``."""
    merged = connected_components(joins.relabel_edges(batch, labels), representative=representative)
    new = batch.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels, "node", "left_anti")
    known = labels.unionByName(new.select("node", F.col("node").alias("component")))
    return joins.relabel_labels(known, merged)


class LabelTable:
    """Labels as numbered Parquet versions in a folder, one for each batch, so that a replayed batch rewrites its own."""

    def __init__(self, spark: SparkSession, path: str, representative: str = "max"):
        self.spark, self.path, self.representative = spark, path.rstrip("/"), representative

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        store = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(base):
            return []
        whole = lambda p: store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in store.listStatus(base) if s.getPath().getName().startswith("v=") and whole(s.getPath()))

    def read(self, before: int | None = None) -> DataFrame:
        found = [v for v in self._versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], "node long, component long")
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}")

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        after = absorb(self.read(before=batch_id), batch, self.representative)
        after.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")


def stream_components(edges: DataFrame, table: LabelTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that folds a streaming edge list into ``table``; exactly once, as batches overwrite their version."""
    writer = edges.writeStream.foreachBatch(table.write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
