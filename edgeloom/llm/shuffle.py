"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot; shards hold slot ranges.

The permutation needs no table and no sort of the whole: slot and sequence number follow from each other by arithmetic.
Shards are range partitions of the slots, written by Spark's own writer as plain files of fixed-stride records: record i of
the training order is at a computed file and offset, and a reader resumes anywhere with what the manifest says.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.tokens import word_tokenizer
from edgeloom.session import ensure_checkpoint_dir, release, stable

#: Ids of a record.
RECORD_IDS = 256
#: Records of a shard: 32 MB with two-byte ids. A shard is one task's; it is sorted by Spark, which spills.
SHARD_RECORDS = 65_536
#: Shards at most; beyond that they get more records.
MOST_SHARDS = 100_000
ROUNDS = 6
#: Records that are dealt to shards at once: 16 MB.
PARCEL_RECORDS = 32_768
#: Rounds in which shards are written: a round's shuffle holds its own shards' records only.
WAVES = 4
#: Buckets in which documents are numbered; the driver keeps one start for each.
BUCKETS = 65_536
#: Compression of ids on their way: they are read once or twice and then deleted.
LEVEL = 3
PARCEL_LEVEL = 1


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit mixing function (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even power of two, walked until inside."""

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(1, n - 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.sha256(f"feistel:{seed}".encode()).digest() + hashlib.sha256(f"feistel+:{seed}".encode()).digest()
        self.keys = np.frombuffer(digest, "<u8")[:rounds]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (_mix(left, key) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x).astype(np.uint64)
        out = self._once(x, back)
        while len(at := np.flatnonzero(out >= np.uint64(self.n))):
            out[at] = self._once(out[at], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def id_bytes(tokenizer: str) -> int:
    """Bytes of an id: two where the vocabulary's largest id fits, else four."""
    return 2 if word_tokenizer(tokenizer).largest < 1 << 16 else 4


def records(docs: DataFrame, tokenizer: str, record_ids: int = RECORD_IDS, end_id: int = 0) -> DataFrame:
    """``doc_id, tie, crcs, ids``: a document's ids and the end id as whole padded records, compressed; CRC-32 of each record."""
    kind = f"<u{id_bytes(tokenizer)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pack, stride = word_tokenizer(tokenizer), zstandard.ZstdCompressor(level=LEVEL), int(kind[2]) * record_ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                tie, ids, crcs, ends = [], [], [], [0]
                for raw in tok.encode(b.column(1).to_pylist()):
                    x = np.frombuffer(raw, "<u4")
                    padded = np.full((len(x) // record_ids + 1) * record_ids, end_id, kind)
                    padded[: len(x)] = x
                    view = memoryview(padded.tobytes())
                    crcs += [zlib.crc32(view[i : i + stride]) for i in range(0, len(view), stride)]
                    tie.append(zlib.crc32(raw)), ids.append(pack.compress(view)), ends.append(len(crcs))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(crcs, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tie, pa.int64()), listed, pa.array(ids, pa.binary())], names=["doc_id", "tie", "crcs", "ids"])

    of = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return of.mapInArrow(run, "doc_id long, tie long, crcs array<long>, ids binary")


def numbered(recs: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, np.ndarray, int]:
    """The records by bucket and in order within it, the number of each bucket's first record, and the number of all records.

    Documents are dealt to buckets by hash; buckets' starts come from a prefix sum over one row a bucket, and documents are
    numbered within their bucket by id. So numbers depend on the rows alone, not on how they were partitioned. A partition of
    the result holds whole buckets, one after the other.
    """
    d = recs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int"))
    d = stable(d.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "tie").select("bucket", "doc_id", "crcs", "ids"))
    release(d.sparkSession, at_once=True)
    count = np.zeros(buckets, np.int64)
    for bucket, n in d.groupBy("bucket").agg(F.sum(F.size("crcs").cast("long"))).collect():
        count[bucket] = n
    return d, np.cumsum(count) - count, int(count.sum())


def opened_records(ids: pa.Array, of: np.ndarray, mine: np.ndarray, width: int, decompress: Callable[[bytes], bytes]) -> Iterator[tuple[bytes, int, int]]:
    """The bytes of the records that are ``mine``, some documents at a time, and where those documents' records begin and end.

    of: each record's document. Only documents with a record of ``mine`` are opened; a round has none of many.
    """
    for at in range(0, len(ids), 256):
        i, j = np.searchsorted(of, (at, at + 256)).tolist()
        place, wanted = of[i:j] - at, np.zeros(256, bool)
        wanted[place[mine[i:j]]] = True
        data = b"".join(map(decompress, ids.take(pa.array(at + np.flatnonzero(wanted))).to_pylist()))
        yield np.frombuffer(data, f"V{width}")[mine[i:j][wanted[place]]].tobytes(), i, j


def materialize(docs: DataFrame, tokenizer: str, path: str, seed: int = 0, record_ids: int = RECORD_IDS, shard_records: int = SHARD_RECORDS, end_id: int = 0) -> DataFrame:
    """Writes shards and manifest below ``path``, a fresh folder; returns ``doc_id, piece, number, slot, shard, position, crc32``.

    Record ``slot`` of the training order is in shard ``slot // shard_records`` of the manifest, at byte
    ``position = (slot % shard_records) * stride``: little-endian ids, then a line end. Every document has at least one
    record, an empty or null text one with end ids only; null and repeated ids stay. No rows give a manifest without shards.

    Spark's writer commits whole shards to whatever file system the path names, so a lost executor or a task that runs twice
    leaves nothing behind. Two ``materialize`` runs must not share a folder.
    """
    spark, width = docs.sparkSession, id_bytes(tokenizer)
    recs, first, total = numbered(records(docs, tokenizer, record_ids, end_id))
    while -(-total // shard_records) > MOST_SHARDS:
        shard_records *= 2
    shards, stride, permutation = -(-total // shard_records), width * record_ids + 1, Feistel(max(1, total), seed)
    starts = spark.sparkContext.broadcast(first)  # one number a bucket

    class Numbers:
        """Numbers the records of a task's rows, which come bucket by bucket and in order within each."""

        def __init__(self):
            self.bucket, self.following = -1, 0

        def of(self, buckets: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row, place in the document, and number of each record."""
            before = np.cumsum(k) - k
            new = np.flatnonzero(np.diff(buckets, prepend=self.bucket))
            begin = np.full(len(k), self.following) + before
            for i, j in zip(new, [*new[1:], len(k)], strict=False):  # none new: no turns
                begin[i:j] = starts.value[buckets[i]] + before[i:j] - before[i]
            self.bucket, self.following = int(buckets[-1]), int(begin[-1] + k[-1])
            of = np.repeat(np.arange(len(k)), k)
            piece = np.arange(len(of)) - before[of]
            return of, piece, begin[of] + piece

    def dealer(low: int, high: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each shard that some thousand records go to: their slots and, compressed, their ids."""
            pack, unpack, count = zstandard.ZstdCompressor(level=PARCEL_LEVEL), zstandard.ZstdDecompressor(), Numbers()
            held, slots, waiting = [], [], 0

            def parcels() -> pa.RecordBatch:
                slot = np.concatenate(slots)
                order = np.argsort(slot)
                slot = slot[order]
                data = np.frombuffer(b"".join(held), f"V{stride - 1}")[order]
                shard = slot // shard_records
                cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
                blobs = [pack.compress(data[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(slot))
                return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]] - low, pa.int32()), listed, pa.array(blobs, pa.binary())], names=["shard", "slots", "ids"])

            for batch in batches:
                k = batch.column(1).value_lengths().to_numpy().astype(np.int64)
                if not len(k):
                    continue
                of, _, number = count.of(batch.column(0).to_numpy(), k)
                slot = permutation.slots(number)  # at once: its steps have a cost of their own
                mine = (slot >= low * shard_records) & (slot < high * shard_records)
                for data, i, j in opened_records(batch.column(2), of, mine, stride - 1, unpack.decompress):
                    held.append(data), slots.append(slot[i:j][mine[i:j]])
                    waiting += len(slots[-1])
                    if waiting >= PARCEL_RECORDS:
                        yield parcels()
                        held, slots, waiting = [], [], 0
            if waiting:
                yield parcels()

        return deal

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for slots, z in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = pa.py_buffer(unpack.decompress(z))
                n = len(slots)
                fixed = pa.Array.from_buffers(pa.binary(stride - 1), n, [None, data])
                yield pa.RecordBatch.from_arrays([slots.values, fixed.cast(pa.binary())], names=["slot", "ids"])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Numbers()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                of, piece, number = count.of(b.column(0).to_numpy(), b.column(2).value_lengths().to_numpy().astype(np.int64))
                slot = permutation.slots(number)
                columns = [b.column(1).take(pa.array(of)), *[pa.array(x) for x in (piece, number, slot, slot // shard_records, slot % shard_records * stride)], b.column(2).flatten()]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "number", "slot", "shard", "position", "crc32"])

    cuts = [shards * i // WAVES for i in range(WAVES + 1)]
    for wave, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if low < high:
            dealt = recs.select("bucket", "crcs", "ids").mapInArrow(dealer(low, high), "shard int, slots array<long>, ids binary")
            ranged = dealt.repartitionById(high - low, F.col("shard")).select("slots", "ids")
            rows = ranged.mapInArrow(opened, "slot long, ids binary").sortWithinPartitions("slot")
            # bytes pass the text writer as they are; each row ends with a line end, which is the record's last byte
            rows.select(F.col("ids").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(f"{path}/shards-{wave}")
            del dealt, ranged, rows
            release(spark, at_once=True)  # the round's shuffle
    manifest = {"total": total, "seed": seed, "record_ids": record_ids, "id_bytes": width, "stride": stride, "shard_records": shard_records, "cuts": cuts, "end_id": end_id}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return recs.select("bucket", "doc_id", "crcs").mapInArrow(located, "doc_id long, piece long, number long, slot long, shard long, position long, crc32 long")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").head()[0])


def read_records(spark: SparkSession, path: str, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Records ``start`` to ``start + count`` (all the rest by default) of the training order, one shard's file at a time.

    Needs the folder alone, on any file system that Spark reads; ids come as unsigned integers of the manifest's width.
    """
    m = read_manifest(spark, path)
    stride, per, kind = m["stride"], m["shard_records"], f"<u{m['id_bytes']}"
    slot, end = max(0, start), m["total"] if count is None else min(m["total"], start + count)
    while slot < end:
        shard = slot // per
        wave = bisect.bisect_right(m["cuts"], shard) - 1
        # the writer names a file by its partition, and partitions are the round's shards
        name = f"part-{shard - m['cuts'][wave]:05d}-*"
        (data,) = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", name).load(f"{path}/shards-{wave}").select("content").collect()]
        for slot in range(slot, min(end, (shard + 1) * per)):
            at = slot % per * stride
            yield np.frombuffer(data, kind, m["record_ids"], at)
        slot += 1


def shared_folder(docs: DataFrame, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
