"""Best-fit packing: few-document length patterns, repeat counts by non-negative least squares, residuals by best fit.

Planning works on the histogram of lengths alone (one number a length, whatever the corpus), and yields for each length a
list of runs of places; every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.text import constant_array
from edgeloom.llm.tokens import word_tokenizer
from edgeloom.session import stable

#: Tokens of a sequence.
CAPACITY = 2048
#: Lengths are rounded up to multiples of this for the patterns.
GRAIN = 8
#: Documents of a pattern at most.
PATTERN_DOCS = 3
#: Shares of the fitted repeats that are planned; the rest stays with the residuals, whose short pieces fill the patterns' slack.
#: Each is tried on the histogram, and the plan with the fewest sequences is taken.
SHARES = (0.75, 0.5, 0.25)
#: Pieces of a length that are ranked in one place; a length that has more is split into as many parts as that takes.
RANKED = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32``: every text's ids and the end id, cut after each ``capacity`` ids.

    A null text counts as empty and gives the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        rows.append((doc, k, s // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson 1974); normal equations for the free columns only."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope)) if len(slope) else 0
        if not len(slope) or slope[j] <= tolerance:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            mine = a[:, at]
            g = mine.T @ mine
            trial = np.linalg.solve(g + 1e-10 * np.trace(g) / len(at) * np.eye(len(at)), mine.T @ b)
            if trial.min() > 0:
                x[:] = 0
                x[at] = trial
                break
            down = trial <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - trial[down], 1e-300))
            x[at] += step * (trial - x[at])
            drop = at[(x[at] <= 1e-9) & down]
            if not len(drop):
                drop = at[down]
            free[drop] = False
            x[drop] = 0
            if not free.any():
                break
    return x


def patterns(present: list[int], capacity: int, most: int) -> list[tuple[int, ...]]:
    """Ascending tuples of two to ``most`` (2 or 3) of the present lengths that fill ``capacity`` exactly."""
    have, out = set(present), []
    for i, a in enumerate(present):
        if 2 * a <= capacity and capacity - a in have:
            out.append((a, capacity - a))
        if most >= 3:
            for b in present[i:]:
                c = capacity - a - b
                if c < b:
                    break
                if c in have:
                    out.append((a, b, c))
    return out


def fit(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, most: int = PATTERN_DOCS) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The patterns of a histogram's rounded lengths, and how often each is fitted to occur."""
    h: dict[int, int] = defaultdict(int)
    for n, c in histogram.items():
        if c and n < capacity:
            h[-(-n // grain)] += c
    sizes = sorted(h)
    pats = patterns(sizes, capacity // grain, most)
    at = {s: i for i, s in enumerate(sizes)}
    a = np.zeros((len(sizes), len(pats)))
    for j, p in enumerate(pats):
        for s in p:
            a[at[s], j] += 1
    return pats, nnls(a, np.array([h[s] for s in sizes], float)) if pats else np.empty(0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, most: int = PATTERN_DOCS, share: float = SHARES[0], fitted: tuple[list[tuple[int, ...]], np.ndarray] | None = None) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Runs ``(count, first sequence, offset)`` of each length's places in order of rank, and the number of sequences.

    The nth piece of a length takes the nth place of its runs. All pieces of the histogram get exactly one place.
    """
    pats, repeats = fitted or fit(histogram, capacity, grain, most)
    left = {n: c for n, c in sorted(histogram.items()) if c}
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # slack: (first sequence, count)
    used = 0
    if capacity in left:
        runs[capacity].append((left.pop(capacity), 0, 0))
        used = runs[capacity][0][0]
    bins = defaultdict(list)
    for n in left:
        bins[-(-n // grain)].append(n)
    if len(pats):
        remain, alive = {s: sum(left[n] for n in bins[s]) for s in bins}, list(left)
        times = np.floor(share * repeats + 1e-6).astype(int)
        for j in np.argsort(-times, kind="stable"):
            need = Counter(pats[j])
            k = min(int(times[j]), *(remain[s] // c for s, c in need.items()))
            if k <= 0:
                continue
            for s, c in need.items():
                remain[s] -= c * k
            # Exact lengths for k copies: the longest of each bin, and for the last slot whatever best fills the rest.
            # As many copies at once as have the same lengths.
            while k:
                chosen: list[int] = []
                for i, s in enumerate(reversed(pats[j])):
                    room = capacity - sum(chosen)
                    at_most = room if i == len(pats[j]) - 1 else min(room, s * grain)
                    q = bisect.bisect_right(alive, at_most) - 1
                    while q >= 0 and left[alive[q]] <= chosen.count(alive[q]):
                        q -= 1
                    if q < 0:
                        break
                    chosen.append(alive[q])
                if len(chosen) < len(pats[j]):
                    break
                count = min(k, *(left[n] // chosen.count(n) for n in chosen))
                offset = 0
                for n in chosen:
                    runs[n].append((count, used, offset))
                    offset += n
                    left[n] -= count
                    if not left[n]:
                        alive.remove(n)
                if offset < capacity:
                    open_[capacity - offset].append((used, count))
                used += count
                k -= count
    # residuals, longest first, each into the open sequences with the least slack that holds it
    slacks = sorted(s for s in open_ if s)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            i = bisect.bisect_left(slacks, n)
            if i < len(slacks):
                slack = slacks[i]
                first, count = open_[slack].pop()
                take = min(c, count)
                if take < count:
                    open_[slack].append((first + take, count - take))
                elif not open_[slack]:
                    del open_[slack]
                    slacks.pop(i)
            else:
                slack, first, take = capacity, used, -(-c // (capacity // n))
                used += take
            runs[n].append((take, first, capacity - slack))
            c -= take
            rest = slack - n
            if rest:
                if rest not in open_:
                    bisect.insort(slacks, rest)
                open_[rest].append((first, take))
    return dict(runs), used


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, most: int = PATTERN_DOCS) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """The plan with the fewest sequences among the planned ``SHARES`` of one fit."""
    fitted = fit(histogram, capacity, grain, most)
    return min((plan(histogram, capacity, grain, most, share, fitted) for share in SHARES), key=lambda p: p[1])


def place(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, most: int = PATTERN_DOCS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    Reads ``pieces`` twice: hand it a checkpointed table. Offsets are gapless from 0 within a sequence.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # capacity rows at most
    runs, _ = best_plan(histogram, capacity, grain, most)
    table = {}
    for n, rs in runs.items():
        counts = np.array([r[0] for r in rs], np.int64)
        table[n] = (np.cumsum(counts) - counts, np.array([r[1] for r in rs], np.int64), np.array([r[2] for r in rs], np.int64))
    parts = F.get(constant_array([float(-(-histogram.get(n, 0) // RANKED) or 1) for n in range(capacity + 1)]), F.col("length").cast("int")).cast("long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts))
    starts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("salt")
    starts = starts.select("length", "salt", (F.sum("n").over(w) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    # a row for each length, and one for every RANKED pieces: the broadcast is bounded by capacity and a millionth of the pieces
    ranked = salted.withColumn("r", rank).join(F.broadcast(starts), ["length", "salt"])
    ranked = ranked.withColumn("r", F.col("r") - 1 + F.col("before")).drop("salt", "before")
    names = [c for c in ranked.columns if c != "r"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            r = b.column(b.schema.get_field_index("r")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                start, first, place_ = table[int(n)]
                i = np.searchsorted(start, r[at], "right") - 1
                sequence[at], offset[at] = first[i] + r[at] - start[i], place_[i]
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces placed in sequences of at most ``capacity`` tokens.

    Null texts are empty, repeated rows are packed as often as they occur, null ids are kept, no rows give no pieces.
    """
    return place(stable(tokenize(docs, tokenizer, capacity)), capacity)
