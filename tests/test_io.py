"""Sources, sinks and the stream."""

import struct

import pytest
from pyspark.sql import functions as F

from edgeloom.plans.components import connected_components
from edgeloom.sources import edges as io
from edgeloom.streaming.incremental import LabelTable, stream_components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_binary_round_trip(spark, tmp_path):
    pairs = [(1, 2), (3, (1 << 63) - 1), (1, 2), (256, 65537)]
    e = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    assert io.write_binary(e, str(tmp_path / "b")) == 4
    assert rows(io.from_binary(spark, str(tmp_path / "b"))) == sorted(pairs)
    assert rows(io.read_graph(spark, str(tmp_path / "b"))) == sorted(set(pairs))


def test_binary_layout_and_range(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(struct.pack("<4Q", 7, 9, 1 << 40, 5))
    assert rows(io.from_binary(spark, str(tmp_path / "x.bin"))) == [(7, 9), (1 << 40, 5)]
    (tmp_path / "y.bin").write_bytes(struct.pack("<2Q", 1 << 63, 5))
    with pytest.raises(Exception):  # noqa: B017
        io.from_binary(spark, str(tmp_path / "y.bin")).collect()


def test_text(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# a\n# b\n0 4\n\n 7\t8 \n")
    assert rows(io.from_text(spark, str(tmp_path / "e.txt"), skip=2, add=3, subtract=1)) == [(2, 6), (9, 10)]
    with pytest.raises(Exception, match="at least 1"):
        io.from_text(spark, str(tmp_path / "e.txt"), skip=2).collect()
    with pytest.raises(Exception, match="no edge"):
        io.from_text(spark, str(tmp_path / "e.txt"), skip=1, add=1).collect()


def test_text_csv_and_replace(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (2, 2)], "u long, v long")
    io.write_text(e, str(tmp_path / "t"))
    assert rows(io.from_text(spark, str(tmp_path / "t"))) == rows(e)
    io.write_csv(e, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    io.write_parquet(e, str(tmp_path / "p"))
    io.replace_parquet(spark, str(tmp_path / "p"), lambda df: df.where("u <> v"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == [(1, 2)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c", "p", "t"]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    e = spark.range(1, 40).select(F.col("id").alias("u"), (F.col("id") * 5 % 41 + 1).alias("v"))
    for i in range(3):
        e.where(F.col("u") % 3 == i).coalesce(1).write.mode("append").parquet(str(source))
    table = LabelTable(spark, str(tmp_path / "labels"))
    stream = spark.readStream.schema("u long, v long").option("maxFilesPerTrigger", 1).parquet(str(source))
    stream_components(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert rows(table.read()) == rows(connected_components(e))
