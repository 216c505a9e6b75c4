"""N-gram Jaccard join by parity sketches: links between all texts whose shingle sets have a similarity of 0.8 or more.

Hash values of a set's shingles are dealt to parts by the hash itself and XORed within each part. Whatever two sets share
cancels, so the number of parts that differ, like the number of differing bits of a one-bit-a-part sketch, is at most the
size of their symmetric difference. For sets of n and m shingles that link, this is at most
``(n + m) * (100 - s) / (100 + s)``; with more parts than that, at least one part agrees (pigeonhole), and that part's XOR is
the join key. Sizes are cut into overlapping bands, so that partners share a band and with it the number of parts.

With d differing parts at most, two linked sets of f and g keys have all but d in common. Of any one order of all keys, the
last ``d + 1`` of both then hold one that they share. Keys are ordered by how many classes hold them, and every class is
indexed under its ``d + 1`` rarest only: a passage that thousands of texts quote is no key where enough else is in the text.

Parts that are empty on both sides agree without saying anything and give no key. The number of parts is chosen so that a
link all of whose shared shingles fall into differing parts has a probability below 1e-12; see ``parts_of``.

Equal sets are one class from the start (by 63 bits of hash). Every class is compared with the centre of each of its keys
first: the class with the fewest keys of its own, which in a cluster of near copies is close to all of them. What is then
still in different components is compared within small groups by a join; in large ones by blocks of sketches, from which
only pairs that may link come out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.components import connected_components
from edgeloom.session import release, stable

SHINGLE = 5
PERCENT = 80
#: Classes of a key up to which pairs in different components are compared within its group.
SMALL_GROUP = 16
#: Classes of a large key whose sketches a task holds at once, on either side.
GROUP_BLOCK = 8192
#: Words of sketches compared at once.
COMPARE_WORDS = 1 << 20
#: Ids sent as a broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Characters hashed at once.
BLOCK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
WORD = re.compile("[^\x20\x09-\x0d]+")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_ODD, _ODD_INVERSE))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` of each distinct shingle of each text, ordered by owner, then hash.

    A-Z count as a-z; fewer than k words make one shingle of all words; no words, none. Words are hashed all at once: prefix
    sums of byte times power, wrapped to 64 bits, differ by a word's polynomial, which the inverse power brings to its start.
    """
    raw = b"\n".join(texts)
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    word = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        words = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.searchsorted(np.cumsum(sizes), start, "right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[owner]
    heads = np.flatnonzero((place <= count[owner] - k) | ((count[owner] < k) & (place == 0)))
    of = owner[heads]
    with np.errstate(over="ignore"):
        h = np.zeros(len(heads), np.uint64)
        for j in range(k):
            at = np.minimum(heads + j, len(words) - 1)
            h = mix(h * _ODD + np.where(place[heads] + j < count[of], words[at], np.uint64(j)), j + 1)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[keep], h[keep]


@lru_cache(maxsize=4096)
def band_of(n: int, percent: int = PERCENT) -> int:
    """The band that starts at or below n; bands start at powers of 100 / percent, rounded up."""
    b = max(0, math.floor(math.log(n) / math.log(100 / percent)) - 1)
    while band_start(b + 1, percent) <= n:
        b += 1
    return b


@lru_cache(maxsize=4096)
def band_start(b: int, percent: int = PERCENT) -> int:
    return math.ceil((100 / percent) ** b - 1e-9)


def most_different(total: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of two sets with ``total`` shingles together that link."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def parts_of(b: int, percent: int = PERCENT) -> tuple[int, int]:
    """``(parts, differing parts at most)`` for pairs whose smaller set starts band b.

    With d differing parts of k, a link is missed only if all its shared shingles, at least I, fall into these: probability
    (d / k) ** I at most, kept below 1e-12. A few parts more are spare, for keys that are too common to be of use.
    """
    small, end = band_start(b, percent), band_start(b + 1, percent)
    largest = max(small, end - 1)
    d = most_different(largest + largest * 100 // percent, percent)
    shared = max(1, math.ceil(2 * small * percent / (100 + percent)))
    if d == 0:
        return 1, 0
    return math.ceil(max(1.15 * d + 2, d * math.exp(27.7 / shared))), d


def set_digests(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and 63-bit digests of the sets, as even numbers (0, 0 for empty ones)."""
    n = np.bincount(owner, minlength=texts)
    a = np.zeros(texts, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        with np.errstate(over="ignore"):
            a[some] = mix(mix(np.add.reduceat(mix(h, 101), at), 7) ^ n[some].astype(np.uint64), 8) & ~np.uint64(1)
    return n, a


def bit_sketch(h: np.ndarray) -> bytes:
    """Parity sketch of two to four bits a shingle: each flips the bit its hash names."""
    bits = 128 << max(0, (len(h) // 64).bit_length())
    flips = np.bincount((mix(h, 303) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(flips & 1).tobytes()


def _fold(raw: np.ndarray, size: int) -> np.ndarray:
    while len(raw) > size:  # the low bits of the position name the place, so halves lie on top of each other
        raw = raw[: len(raw) // 2] ^ raw[len(raw) // 2 :]
    return raw


def sketch_distance(a: bytes, b: bytes) -> int:
    """Differing bits; the longer sketch is folded onto the shorter, which keeps the bound."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())


def _parts(owner: np.ndarray, h: np.ndarray, sizes: np.ndarray, lower: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each set's band (the one below its own if ``lower``), parts and differing parts at most; and the part of each hash.

    The last item names the places of the hashes that have a part: sets in the lowest band have none below.
    """
    band, k, d = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for n in np.unique(sizes[sizes > 0]):
        at = sizes == n
        band[at] = band_of(int(n), percent) - lower
    for b in np.unique(band[band >= 0]):
        k[band == b], d[band == b] = parts_of(int(b), percent)
    at = np.flatnonzero(k[owner] > 0)
    o = owner[at]
    part = ((mix(h[at], 404) >> np.uint64(32)) * k[o].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    return band, k, d, part, at


def part_counts(owner: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, spare keys)`` of each set, for its own band and the one below: ``2 x sets`` each. All but ``d + 1`` are spare."""
    filled, spare = np.zeros((2, len(sizes)), np.int64), np.zeros((2, len(sizes)), np.int64)
    for lower in (0, 1):
        _, k, d, part, at = _parts(owner, h, sizes, lower, percent)
        base = np.cumsum(k) - k
        used = np.zeros(int(k.sum()) + 1, np.int64)
        used[base[owner[at]] + part] = 1
        before = np.concatenate([[0], np.cumsum(used)])
        filled[lower] = before[base + k] - before[base]
        spare[lower] = np.maximum(0, filled[lower] - d - 1)
    return filled, spare


def part_keys(owner: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all sets in both their bands: ``(owner, 1 in the band below the own, key)``."""
    outs, lows, keys = [], [], []
    for lower in (0, 1):
        band, k, _, part, at = _parts(owner, h, sizes, lower, percent)
        base = np.cumsum(k) - k
        cell = base[owner[at]] + part
        order = np.argsort(cell, kind="stable")
        if not len(order):
            continue
        cell, value, who = cell[order], h[at][order], owner[at][order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        who = who[first]
        where = (cell[first] - base[who]).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys.append(mix(np.bitwise_xor.reduceat(value, first) ^ mix(where + (band[who].astype(np.uint64) << np.uint64(40)), 505)))
        outs.append(who), lows.append(np.full(len(who), lower))
    if not outs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(outs), np.concatenate(lows), np.concatenate(keys)


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    held, at, size = [], 0, 0
    for i, t in enumerate(batch.column(column).to_pylist()):
        held.append(t.encode() if t else b"")
        size += len(held[-1])
        if size >= BLOCK_BYTES:
            yield at, held
            held, at, size = [], i + 1, 0
    if held:
        yield at, held


def describe(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n, s, keys, spare, spare_low, sketch`` of every row: set size, class, keys in both bands, and the bit sketch.

    spare, spare_low: keys of the own band and of the one below that its index can do without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _blocks(batch, 1):
                owner, h = shingle_sets(texts)
                n, s = set_digests(owner, h, len(texts))
                filled, spare = part_counts(owner, h, n, percent)
                ends = np.cumsum(n)
                sketches = [bit_sketch(h[e - c : e]) if c else b"" for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                counts = [pa.array(x, pa.int64()) for x in (n, s.view(np.int64), filled.sum(axis=0), *spare)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *counts, pa.array(sketches, pa.binary())], names=["doc_id", "n", "s", "keys", "spare", "spare_low", "sketch"])

    of = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return of.mapInArrow(run, "doc_id long, n long, s long, keys long, spare long, spare_low long, sketch binary")


def keyed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``key, s``: the join keys of every non-empty text under its class; s is odd for keys of the band below the class's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _blocks(batch, 0):
                owner, h = shingle_sets(texts)
                n, s = set_digests(owner, h, len(texts))
                who, lower, key = part_keys(owner, h, n, percent)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(s[who].view(np.int64) | lower)], names=["key", "s"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, s long")


def _near(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose sizes and sketches allow a link."""
    side = lambda p: light.select(F.col("s").alias(p), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"k{p}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, na, nb, ka, kb = (b.column(i).to_pylist() for i in range(6))
            keep = [sketch_distance(x, y) <= most_different(i + j, percent) for x, y, i, j in zip(ka, kb, na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a_, b_)], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, light: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` of classes that link: first by sketch, then by their shingle sets."""
    near = stable(_near(pairs, light, percent))
    wanted = near.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    named = stable(wanted.join(light.select("s", "doc_id"), "s"))
    ids = named.select("doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if named.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    of_class = stable(describe_sets(texts.join(ids, "doc_id", "left_semi")).join(named.select("s"), "s", "left_semi").groupBy("s").agg(F.first("h").alias("h")))
    side = lambda p: of_class.select(F.col("s").alias(p), F.col("h").alias(f"h{p}"))
    joined = near.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def describe_sets(docs: DataFrame) -> DataFrame:
    """``s, h``: class and packed shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _blocks(batch, 1):
                owner, h = shingle_sets(texts)
                n, s = set_digests(owner, h, len(texts))
                ends = np.cumsum(n)
                packed = [h[e - c : e].tobytes() for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(packed, pa.binary())], names=["s", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, "s long, h binary")


def linked_components(docs: DataFrame, percent: int = PERCENT, small_group: int = SMALL_GROUP, group_block: int = GROUP_BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: component_id is the smallest id reachable by links.

    Empty sets link with nothing, equal sets always. A row without an id links nothing together and has no component id.
    Rows that share an id are one node.
    """
    full = stable(describe(docs, percent))
    rows = full.where("n > 0 and doc_id is not null")
    # one row for each class: its smallest id, size and sketch. Summed map-side, so a large group of copies is cheap.
    light = rows.groupBy("s").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "keys", "spare", "spare_low", "sketch")])
    light = stable(light)
    members = _index(_shared_keys(docs, percent), light)
    release(docs.sparkSession, at_once=True)  # the shuffle of all keys
    pair = lambda x: (F.least("s", x).alias("a"), F.greatest("s", x).alias("b"))
    # first every class with the best of its keys' centres, then, for what is left apart, with all of these
    nearest = members.groupBy("s").agg(F.min("centre").alias("centre")).select("s", F.col("centre.s").alias("lo"))
    first = stable(nearest.where("s <> lo").select(*pair("lo")).distinct())
    members = members.select("key", "s", "size", F.col("centre.s").alias("lo"))
    links = stable(verified(first, docs, light, percent))
    at = _in_components(members, links)
    stars = at.where("s <> lo and c <> clo").select(*pair("lo")).distinct().join(first, ["a", "b"], "left_anti")
    stars = stable(stars)
    links = stable(links.unionByName(verified(stars, docs, light, percent)))
    # what the stars left apart
    at = _in_components(members, links)
    apart = at.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    apart = stable(at.join(apart, "key", "left_semi").select("key", "s", "c", "size"))
    side = lambda p: apart.where(F.col("size") <= small_group).select("key", F.col("s").alias(p), F.col("c").alias(f"c{p}"))
    within = side("a").join(side("b"), "key").where("a < b and ca <> cb").select("a", "b")
    across = _near_in_groups(apart.where(F.col("size") > small_group), light, percent, group_block)
    more = within.unionByName(across).distinct().join(first, ["a", "b"], "left_anti").join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(stable(verified(stable(more), docs, light, percent)))
    # classes to ids: copies hang on their class's smallest id
    name = light.select("s", F.col("doc_id").alias("id"))
    between = links.join(name.toDF("a", "u"), "a").join(name.toDF("b", "v"), "b").select("u", "v")
    copies = rows.join(name, "s").where("doc_id <> id").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    edges = between.unionByName(copies).where("u <> v")
    labels = connected_components(edges, representative="min").select(F.col("node").alias("doc_id"), "component")
    out = full.select("doc_id", F.col("n").alias("n_shingles")).join(labels, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _shared_keys(docs: DataFrame, percent: int) -> DataFrame:
    """``key, s``: the classes of every key that two or more hold."""
    keys = keyed(docs.where("doc_id is not null"), percent).repartition("key")
    # both uses of the keys read one shuffle; a class may hold a key in one of its bands only, so the bit for it tells no classes apart
    several = keys.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi")
    return stable(keys.join(several.select("key").hint("shuffle_hash"), "key").distinct())


def _index(shared: DataFrame, light: DataFrame) -> DataFrame:
    """``key, s, size, centre``: every class under its rarest keys, the classes of a key so indexed, and their centre.

    centre: ``(own keys, s)`` of the class with the fewest keys that no other class holds.
    """
    held = shared.groupBy("key").agg(F.count(F.lit(1)).alias("holders"))
    k = shared.join(held, "key").select("key", "holders", F.col("s").bitwiseAND(F.lit(-2)).alias("s"), F.col("s").bitwiseAND(F.lit(1)).alias("lower"))
    k = k.join(light.select("s", "keys", "spare", "spare_low"), "s")
    common_first = Window.partitionBy("s", "lower").orderBy(F.desc("holders"), "key")
    k = k.withColumn("r", F.row_number().over(common_first)).withColumn("own", F.col("keys") - F.count(F.lit(1)).over(Window.partitionBy("s")))
    k = stable(k.where(F.col("r") > F.when(F.col("lower") == 1, F.col("spare_low")).otherwise(F.col("spare"))).select("key", "s", "own"))
    groups = k.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "s")).alias("centre")).where("size > 1")
    return stable(k.join(groups, "key").select("key", "s", "size", "centre"))


def _in_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the component of their class (``c``) and of their key's centre (``clo``)."""
    found = stable(connected_components(links.toDF("u", "v"), representative="min"))
    at = members.join(found.select(F.col("node").alias("s"), F.col("component").alias("c")), "s", "left")
    at = at.join(found.select(F.col("node").alias("lo"), F.col("component").alias("clo")), "lo", "left")
    return stable(at.select("key", "s", "lo", "size", F.coalesce("c", "s").alias("c"), F.coalesce("clo", "lo").alias("clo")))


def _near_in_groups(groups: DataFrame, light: DataFrame, percent: int, block: int) -> DataFrame:
    """``a, b``: pairs in different components of a key whose sizes and sketches allow a link, for ``key, s, c, size`` rows.

    Groups are cut into blocks by hashes of their classes, and every two blocks of a key meet in one place: a task holds two
    blocks of sketches and hands on only pairs that may link. Classes of a group's largest component are not compared with
    one another.
    """
    of = groups.join(light.select("s", "n", "sketch"), "s")
    blocks = F.ceil(F.col("size") / block).cast("int")
    of = of.withColumn("mine", F.pmod(F.xxhash64("s"), blocks).cast("int"))
    of = of.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    of = of.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "s", "c", "n", "sketch")

    def compare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        same = rows["p"][0].as_py() == rows["q"][0].as_py()
        mine, s, c, n = (rows[x].to_numpy() for x in ("mine", "s", "c", "n"))
        raw = [np.frombuffer(x, np.uint8) for x in rows["sketch"].to_pylist()]
        width = min(map(len, raw))
        sketch = np.stack([_fold(x, width) for x in raw]).view(np.uint64)
        names, of_name, count = np.unique(c, return_inverse=True, return_counts=True)
        main, here = of_name == count.argmax(), mine == mine.min()
        if same:
            sides = [(~main, main | ~main)]
        else:
            sides = [(here & ~main, ~here), (here & main, ~here & ~main)]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for left, right in ([np.flatnonzero(x) for x in xy] for xy in sides):
            step = max(1, COMPARE_WORDS // max(1, len(right) * sketch.shape[1]))
            for i in range(0, len(left), step):
                x = left[i : i + step]
                nx, ny = n[x][:, None], n[right][None, :]
                allowed = (nx + ny) * (100 - percent) // (100 + percent)
                allowed[(c[x][:, None] == c[right][None, :]) | (nx * 100 < ny * percent) | (ny * 100 < nx * percent)] = -1
                far = np.bitwise_count(sketch[x][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int64)
                u, v = np.nonzero(far <= allowed)
                a.append(s[x[u]]), b.append(s[right[v]])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pairs[0], pairs[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def out() -> pa.RecordBatch:
            a, b = compare(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            place = [batch.column(i).to_numpy() for i in range(3)]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(x) != 0 for x in place], axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                here = tuple(x[i] for x in place)
                if held and here != at:
                    yield out()
                    held.clear()
                at = here
                held.append(batch.slice(i, j - i))
        if held:
            yield out()

    return of.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long")
