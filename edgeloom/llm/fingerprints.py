"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits, bias-corrected.

DataFrame functions only. One hash for each five-word shingle; its top bits name the bin, and a sort of a primitive array
brings each bin's smallest value to the front. An empty bin borrows from the first full bin in a random order of its own, so
alike sets borrow alike and bins borrow independently.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.text import words_of

SHINGLE = 5
#: log2 of the bins.
BIN_BITS = 8
#: Low-order bits kept of each bin's value.
LOW_BITS = 8
#: Quantiles of the ids in ``with_next``, and bytes of the rows that one place takes: ranges between quantiles that hold more
#: are cut again.
QUANTILES = 256
PLACE_BYTES = 1 << 26
#: Donors that an empty bin tries one by one, in an order of its own, before it looks at all full bins. Whatever bins are full,
#: a bin's order of donors is the same: alike texts borrow alike.
TRIES = 16


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """One hash for each run of k words; fewer words make one run; none without words."""
    n = F.size(words)
    starts = F.slice(words, 1, F.greatest(n - (k - 1), F.least(n, F.lit(1))))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))


def donor_orders(bins: int) -> list[list[int]]:
    """For each bin, all bins in a random order of its own, from a fixed seed."""
    out = []
    for j in range(bins):
        order = list(range(bins))
        random.Random(1_000_003 * j + bins).shuffle(order)
        out.append(order)
    return out


def sketch(df: DataFrame, words: str, out: str, bin_bits: int = BIN_BITS, low_bits: int = LOW_BITS) -> DataFrame:
    """Adds ``out``: an array with the packed value of each bin (null where there are no words)."""
    bins = 1 << bin_bits
    h, first, place, dense = (f"{out}__{x}" for x in ("hashes", "first", "place", "dense"))
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - bin_bits).cast("int")
    df = df.withColumn(h, F.sort_array(shingle_hashes(F.col(words))))
    starts = lambda x, i: (i == 0) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(h, i - 1)), 64 - bin_bits) != 0)
    df = df.withColumn(first, F.filter(h, starts))
    df = df.withColumn(place, F.transform(first, bin_of))
    at = lambda b: (F.array_position(place, b) - 1).cast("int")
    all_bins = F.sequence(F.lit(0), F.lit(bins - 1))
    # the size test also keeps the optimizer from computing the places anew inside the lambda: they are used twice
    df = df.withColumn(dense, F.when(F.size(place) > 0, F.transform(all_bins, lambda b: F.get(first, at(b)))))
    donors = F.from_json(F.lit(str([d[:TRIES] for d in donor_orders(bins)])), "array<array<int>>")

    def nearest(b: Column) -> Column:
        """The full bin that a hash with b puts first: always one, at a cost of one hash for each full bin."""
        order = F.transform(place, lambda c, i: F.xxhash64(b, c).bitwiseAND(F.lit(-bins)).bitwiseOR(i.cast("long")))
        return F.get(first, F.array_min(order).bitwiseAND(F.lit(bins - 1)).cast("int"))

    def borrowed(b: Column) -> Column:
        return F.coalesce(*[F.get(dense, F.get(F.get(donors, b), F.lit(t))) for t in range(TRIES)], nearest(b))

    low = lambda v: v.bitwiseAND(F.lit((1 << low_bits) - 1)).cast("short")
    packed = F.transform(dense, lambda v, b: low(F.coalesce(v, borrowed(b))))
    return df.withColumn(out, F.when(F.size(h) > 0, packed)).drop(h, first, place, dense)


def likeness(a: Column, b: Column, low_bits: int = LOW_BITS) -> Column:
    """Estimated Jaccard similarity of two sketches: the share of equal bins, corrected for chance agreement.

    Two sketches without words are alike (1); one without words is like no other (0).
    """
    chance = 2.0**-low_bits
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(estimate)


def packed_string(sketch_: Column, low_bits: int = LOW_BITS) -> Column:
    """The sketch as hexadecimal digits; empty without words."""
    digits = -(-low_bits // 4)
    return F.coalesce(F.array_join(F.transform(sketch_, lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), digits, "0")), ""), F.lit(""))


def with_next(rows: DataFrame, carry: list[str], place_bytes: int = PLACE_BYTES, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, weight: Column | None = None) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the next row by ascending ``doc_id``, the last row's in the first.

    rows: ``doc_id`` (integer), ``tie`` (orders equal ids) and what ``prepare`` makes the carried columns of, row by row; weight:
    bytes of a row. Ids are cut at approximate quantiles, and what lies between two quantiles into equal steps: as many as all
    rows' bytes ask for. Rows of one id that spans quantiles, or of no id, are cut by their ties likewise. Each range is also
    given a copy of the next one's first row, so that looking ahead never leaves it: rows are shuffled once, and no task sees
    more than a range. Null ids come first. A lone row is its own next one.
    """
    slim = rows.select("doc_id", "tie")
    quantiles = F.percentile_approx("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 10_000)
    bounds, least, last, size = rows.agg(quantiles, F.min("doc_id"), F.max("doc_id"), F.sum(F.lit(1) if weight is None else weight)).head()
    bounds = sorted({int(c) for c in bounds or []})
    steps = max(1, -(-int(size or 0) // (place_bytes * QUANTILES)))
    cuts = F.from_json(F.lit(str(bounds)), "array<long>")
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))
    if steps > 1:
        # steps of ties where the id is the quantile itself (or null), then steps of the ids up to the next quantile
        low, high = (F.get(F.from_json(F.lit(str(x)), "array<long>"), at) for x in ([least or 0, *bounds], [*bounds, (last or 0) + 1]))
        by_tie = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * steps), F.lit(steps - 1))
        by_id = F.least(F.floor((F.col("doc_id").cast("double") - low) / (high - low) * steps), F.lit(steps - 1))
        fine = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == low), by_tie).otherwise(F.lit(steps) + by_id)
        at = at * (2 * steps) + fine
    place = at.cast("long")
    # one row for each range reaches the driver: some thousand, or two for every PLACE_BYTES
    firsts = slim.groupBy(place.alias("range")).agg(F.min(F.struct("doc_id", "tie")).alias("f")).orderBy("range").collect()
    ring = [(firsts[i - 1]["range"], r["f"]["doc_id"], r["f"]["tie"]) for i, r in enumerate(firsts)]
    heads = rows.sparkSession.createDataFrame(ring, "range long, head_id long, head_tie long")
    match = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    # so few rows are picked before anything is computed for them
    picked = rows.join(F.broadcast(heads), match).drop("head_id", "head_tie").dropDuplicates(["range"])
    copies = prepare(picked).select("doc_id", "tie", *carry, "range", F.lit(1).alias("copy"))
    both = prepare(rows).select("doc_id", "tie", *carry, place.alias("range"), F.lit(0).alias("copy")).unionByName(copies)
    w = Window.partitionBy("range").orderBy("copy", F.asc_nulls_first("doc_id"), "tie")
    ahead = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return ahead.where("copy = 0").drop("range", "copy", "tie")


def fingerprint_pairs(docs: DataFrame, bin_bits: int = BIN_BITS, low_bits: int = LOW_BITS) -> DataFrame:
    """Sketches of every text (``sketch``) and of its edited form (``edited_sketch``, ``edited``), and ``next_sketch``.

    The edited text has its last ``floor(n / 2)`` of n code points replaced by the first as many of the next document's
    (all of them if it is shorter). A null text counts as empty and has a null sketch, as has any text without words.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketched = lambda df: sketch(df.withColumn("words", words_of(F.col("text"))), "words", "sketch", bin_bits, low_bits).drop("words")
    d = with_next(d.withColumn("tie", F.xxhash64("text")), ["text", "sketch"], prepare=sketched, weight=F.octet_length("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half)
    d = d.withColumn("edited", F.concat(kept, F.substr("next_text", F.lit(1), half))).drop("next_text", "text")
    d = d.withColumn("words", words_of(F.col("edited")))
    return sketch(d, "words", "edited_sketch", bin_bits, low_bits).drop("words")
