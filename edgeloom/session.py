"""Session helpers: settings, and the one place that cuts lineage."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "edgeloom", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` where the cluster names one.

    Only a plain local session without the setting gets a temporary folder; a cluster without it is an error, as a
    machine-local folder there would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="edgeloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Seconds between two clean-ups at least.
CLEAN_EVERY = 4.0
_cleaned = 0.0


def release(spark: SparkSession, at_once: bool = False) -> None:
    """Lets Spark delete shuffles and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with memory to spare may not do for hours; loops that
    write a checkpoint each round would fill the disks meanwhile.
    """
    global _cleaned
    if at_once or time.monotonic() - _cleaned >= CLEAN_EVERY:
        _cleaned = time.monotonic()
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def stable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage is cut, and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


def stable_in_loop(df: DataFrame) -> DataFrame:
    """``stable`` for tables that are made from one another round by round.

    A checkpoint cuts lineage but keeps the planner's estimate of its size. A join's is the product of its sides', so its digits
    multiply with each round, and after a dozen planning takes minutes. The rows are taken over without it here.
    """
    spark, out = df.sparkSession, stable(df)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False), spark)
