"""Mixing sources to target weights: exact block quotas, a multivariate-hypergeometric splitting tree, permuted blocks.

Every source's documents are cut into blocks by a keyed permutation of their ids. The target of a source is met by whole
passes over its blocks, then by whole blocks in permuted order, then by documents of one last block. Which shard gets how many
of a source's blocks is drawn by a tree: each node splits its quota vector between its halves by a multivariate
hypergeometric draw, so shards are random samples without replacement and all quotas add up exactly. The rows themselves are
dealt by DataFrame functions only; the driver sees one row for each source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.text import words_of
from edgeloom.session import stable

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is used up to so many times.
MAX_REPEATS = 3
#: Blocks of a source at least, and words of a block at most.
MIN_BLOCKS = 64
BLOCK_WORDS = 1 << 20
SHARDS = 64
#: Sources whose quotas the driver splits: one row each.
MAX_SOURCES = 1_000_000


def permutation_key(seed: int, *columns: Column) -> Column:
    """The keyed order of documents: a digest as hexadecimal digits, so that any engine can compute it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``skey, source_size, target`` for ``skey, source_size`` rows: shares of the total by weight, capped.

    Sources are weighed in the order of skey. Excess over a cap is shared among the others by weight until no target is over
    its cap: the level at which ``min(cap, level * weight)`` adds up to the total, found by one pass in the order of
    cap / weight.
    """
    place = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    s = sizes.withColumn("weight", weight).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("capped", F.sum("cap").over(by_level) - F.col("cap"))
    s = s.withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    # the first source whose cap is above the level that the rest would get sets the level
    open_ = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), F.col("level"))))
    s = s.withColumn("at", open_.over(everything)["level"])
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight")))
    return s.select("skey", "source_size", target.alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """``shards x sources`` counts: the tree of multivariate hypergeometric draws. Shards' sums differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    capacity = np.array([total * (i + 1) // shards - total * i // shards for i in range(shards)])
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        low, high, q = stack.pop()
        if high - low == 1 or not q.sum():
            out[low] = q
            continue
        middle = (low + high) // 2
        digest = hashlib.sha256(f"{seed}:{low}:{high}".encode()).digest()
        rng = np.random.Generator(np.random.Philox(key=np.frombuffer(digest[:16], np.uint64)))
        left = rng.multivariate_hypergeometric(q, int(capacity[low:middle].sum()), method="marginals")
        stack += [(low, middle, left), (middle, high, q - left)]
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 0, shards: int = SHARDS, most: int = MAX_REPEATS, carry: Sequence[Column] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, draws`` for every document, and the named columns of ``carry``.

    size: words. draws: ``(shard, epoch, position)`` of each time the document is drawn; shards are read in ascending
    position. taken: ``size`` times the draws. Null texts have size 0, a null source is a source of its own, in order after all
    others. Documents without words are drawn in whole passes and where their place falls. Repeated rows are drawn separately. Rows without an id are placed by
    their texts.
    """
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    # rows without an id would all share one place, and with it one block
    pkey = F.when(F.col("doc_id").isNull(), permutation_key(seed, F.lit(None), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))).otherwise(permutation_key(seed, F.col("doc_id")))
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), skey.alias("skey"), F.size(words_of(F.col("text").cast("string"))).cast("long").alias("size"), pkey.alias("pkey"), *carry)
    names = d.columns[5:]
    d = stable(d)
    sums = d.groupBy("skey").agg(F.sum("size").alias("source_size"))
    goal = stable(targets(sums, weights, most))
    blocks_of = F.greatest(F.lit(MIN_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long")
    # passes are whole as far as doubles can tell
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9)))).otherwise(F.lit(0))
    goal = goal.withColumn("blocks", blocks_of).withColumn("whole", whole.cast("int"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    spot = F.conv(F.substring("pkey", 1, 8), 16, 10).cast("long")
    d = d.join(goal, "skey").withColumn("block", F.shiftright(spot * F.col("blocks"), 32))
    # words of each block, and where it begins in its source's permuted order
    per_block = d.groupBy("skey", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    before = F.sum("words").over(Window.partitionBy("skey").orderBy("block")) - F.col("words")
    per_block = per_block.withColumn("begins", before.cast("double"))
    full = F.col("begins") + F.col("words") <= F.col("rest")
    touched = F.col("begins") < F.col("rest")
    per_block = stable(per_block.select("skey", "block", "whole", "rest", "begins", full.alias("full"), (touched & ~full).alias("part")))
    # each pass over a block is one unit of its source's quota; the last block may be used in part
    epochs = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("full") | F.col("part"), 0).otherwise(1))
    used = per_block.where("whole > 0 or full or part")
    units = used.select("skey", "block", F.explode(epochs).alias("epoch"))
    units = units.withColumn("spot", F.xxhash64(F.lit(seed), F.lit("unit"), "skey", "block", "epoch"))
    counts = units.groupBy("skey").agg(F.count(F.lit(1)).alias("n")).orderBy("skey").limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    drawn = split_quotas(np.array([r["n"] for r in counts], np.int64), shards, seed)
    ends = np.cumsum(drawn, axis=0).T.tolist()
    table = docs.sparkSession.createDataFrame([(r["skey"], e) for r, e in zip(counts, ends, strict=True)], "skey string, ends array<long>")
    rank = F.row_number().over(Window.partitionBy("skey").orderBy("spot", "block", "epoch"))
    units = units.withColumn("r", rank).join(table, "skey")
    units = units.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("r"))))
    per = units.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("units"))
    per = per_block.join(per, ["skey", "block"], "left").select("skey", "block", "whole", "rest", "begins", "part", "units")
    d = d.select("doc_id", "source", "skey", "size", "pkey", "source_size", "target", "block", *names).join(per, ["skey", "block"])
    # inside the last block, documents in permuted order as long as they bring the source nearer to its target
    local = F.sum("size").over(Window.partitionBy("skey", "block").orderBy("pkey", "doc_id", "size", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = F.col("begins") + local - F.col("size") / 2 <= F.col("rest")
    units_ = F.when(F.col("part") & ~inside, F.filter("units", lambda u: u["epoch"] < F.col("whole"))).otherwise(F.col("units"))
    d = d.withColumn("units", F.coalesce(units_, F.array().cast("array<struct<epoch:int,shard:int>>")))
    position = lambda u: F.xxhash64(F.lit(seed), u["shard"], u["epoch"], F.col("pkey"))
    draws = F.transform("units", lambda u: F.struct(u["shard"].alias("shard"), u["epoch"].alias("epoch"), position(u).alias("position")))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("units")).alias("taken"), draws.alias("draws"), *names)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix itself: every row as often as it is drawn, columns as they were. Undrawn rows go.

    Rows are told apart by 128 bits of hash over all their columns, so rows without an id are drawn like others, and rows that
    share an id each by their own draws. Rows equal in all columns stand for one another: together they come as often as all
    of them were drawn.
    """
    columns = docs.columns
    keys = F.xxhash64(*columns).alias("__h1"), F.xxhash64(F.lit(0x5BD1E995), *columns).alias("__h2")
    drawn = mix(docs, weights, seed, carry=keys).groupBy("__h1", "__h2")
    drawn = drawn.agg(F.sum(F.size("draws")).cast("int").alias("__n"), F.count(F.lit(1)).alias("__rows")).where("__n > 0")
    joined = docs.select("*", *keys).join(drawn, ["__h1", "__h2"])
    # of equal rows one is repeated for all
    equal = joined.where("__rows > 1").dropDuplicates(["__h1", "__h2"])
    joined = joined.where("__rows = 1").unionByName(equal)
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i")).drop("__i")
