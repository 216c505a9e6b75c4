"""Edge sources and sinks.

Binary edge files hold 16-byte records without a header: two little-endian unsigned 64-bit integers. They are read by
the JVM in splits from any file system Spark knows, and decoded by column expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = 16


def from_columns(df: DataFrame, u: Column | str, v: Column | str) -> DataFrame:
    """Edges from two integer columns; rows with a null end are no edges."""
    u, v = (F.col(x) if isinstance(x, str) else x for x in (u, v))
    return df.select(u.cast("long").alias("u"), v.cast("long").alias("v")).where("u is not null and v is not null")


def from_binary(spark: SparkSession, path: str) -> DataFrame:
    """Scan of binary edge files. Ids from 2**63 up don't fit BIGINT and fail the query."""
    sc = spark.sparkContext
    records = sc._jsc.sc().binaryRecords(path, RECORD, sc._jsc.sc().hadoopConfiguration())
    encoder = sc._jvm.org.apache.spark.sql.Encoders.BINARY()
    raw = DataFrame(spark._jsparkSession.createDataset(records, encoder).toDF(), spark)
    value = raw.columns[0]

    def word(start: int) -> Column:
        high_first = F.concat(*[F.hex(F.substring(value, start + i, 1)) for i in range(7, -1, -1)])
        return F.conv(high_first, 16, 10).cast("decimal(20,0)").cast("long")

    return raw.select(word(1).alias("u"), word(9).alias("v"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Binary scan without duplicates."""
    return from_binary(spark, path).distinct()


def scan_report(scanned: DataFrame) -> DataFrame:
    """One row ``edges_in, kept, dropped`` for a scan and its copy without duplicates."""
    return scanned.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("edges_in"), F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped")
    )


def from_text(spark: SparkSession, path: str, skip: int = 0, add: int = 0, subtract: int = 0) -> DataFrame:
    """Text scan: two decimal integers a line, after ``skip`` header lines of each file; ids are shifted.

    Ids below 1 after the shift, and lines that aren't two integers, fail the query; blank lines are passed over.
    """
    lines = spark.read.text(path)
    if skip:
        lines = lines.select("value", "_metadata.file_path", "_metadata.file_block_start")
        lines = lines.withColumn("__order", F.monotonically_increasing_id())
        at = F.row_number().over(Window.partitionBy("file_path").orderBy("__order"))
        first = lines.where("file_block_start = 0").withColumn("__n", at).where(F.col("__n") > skip).select("value")
        lines = first.unionByName(lines.where("file_block_start > 0").select("value"))
    lines = lines.where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    ok = F.trim("value").rlike(r"^-?\d+\s+-?\d+$")
    number = lambda i: F.when(ok, parts[i]).otherwise(F.raise_error(F.concat(F.lit("no edge: "), F.col("value")))).cast("long")
    out = lines.select((number(0) + add - subtract).alias("u"), (number(1) + add - subtract).alias("v"))
    bad = F.raise_error(F.lit("ids must be at least 1"))
    return out.select(*[F.when(F.col(c) >= 1, F.col(c)).otherwise(bad).cast("long").alias(c) for c in ("u", "v")])


def from_values(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "u long, v long")


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_binary(edges: DataFrame, path: str) -> int:
    """Binary sink: one file of 16-byte records for each task, in the folder ``path``; returns the records written.

    A task writes under a name of its own and renames at its end, so retried and speculative tasks leave one whole
    file. The path must be reachable from all executors.
    """
    columns = edges.columns[:2]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _store(path)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        temporary = f"{base}/_{part:05d}-{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(temporary) as out:
            for b in batches:
                block = np.empty((b.num_rows, 2), "<u8")
                for i in (0, 1):
                    block[:, i] = b.column(i).to_numpy(zero_copy_only=False)
                out.write(block.tobytes())
                n += b.num_rows
        store.move(temporary, f"{base}/part-{part:05d}.bin")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    done = edges.select(*[F.col(c).cast("long") for c in columns]).mapInArrow(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def write_text(df: DataFrame, path: str, mode: str = "error") -> None:
    """Text sink: the columns of a row parted by blanks, a row a line."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    """The default sink: sorted by the first column within files, which compresses adjacency and prunes row groups."""
    df.sortWithinPartitions(*df.columns[:2]).write.mode(mode).parquet(path)


def replace_parquet(spark: SparkSession, path: str, change) -> None:
    """Rewrites a Parquet folder in place: writes the changed rows beside it, then swaps the folders."""
    jvm = spark.sparkContext._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    change(spark.read.parquet(path)).write.parquet(fresh.toString())
    store.rename(here, old)
    if not store.rename(fresh, here):
        store.rename(old, here)
        raise OSError(f"could not replace {path}")
    store.delete(old, True)
