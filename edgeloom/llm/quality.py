"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Every count and every verdict covers whole texts of all documents, by DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.text import SPACE, WORD, constant_array, total, words_of

#: Buckets of hashed one- and two-word grams.
BUCKETS = 1 << 14
#: Mean log ratio per gram from which a document is kept; 0 would ask it to be likelier under the target. Trusted texts score
#: from about -0.03 up whatever their language, texts full of symbols from about -0.06 down.
THRESHOLD = -0.05
#: Counts that the corpus's own shares add to the target: what the target has not seen much of scores near 0.
SMOOTHING = float(BUCKETS)
#: At most so many trusted documents fit the target; the smallest hashes of their ids are taken.
TRUSTED = 20_000


def _repeat_words(d: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in three-word windows that occur twice or more in the text, the first included.

    Windows are hashed; the low bits of each hash give way to the window's position, so one sort of a primitive array
    brings equal windows together. What is equal by hash is compared word by word.
    """
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size("words") + 1))).cast("int")
    d = d.withColumn("bits", bits).withColumn("low", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)
    d = d.withColumn("high", F.bitwise_not("low"))
    starts = F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0)))
    hashed = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    d = d.withColumn("keys", F.sort_array(F.transform(starts, lambda w, i: hashed(w, i).bitwiseAND(F.col("high")).bitwiseOR(i.cast("long")))))

    def same(x: Column, y: Column) -> Column:
        equal = x.bitwiseXOR(y) <= F.col("low")
        equal = equal & (x.bitwiseXOR(y) >= 0)
        at, other = x.bitwiseAND(F.col("low")).cast("int"), y.bitwiseAND(F.col("low")).cast("int")
        for k in range(3):
            equal = equal & (F.get("words", at + k) == F.get("words", other + k))
        return F.coalesce(equal, F.lit(False))

    twins = F.filter("keys", lambda x, i: same(x, F.get("keys", i - 1)) | same(x, F.get("keys", i + 1)))
    d = d.withColumn("at", F.sort_array(F.transform(twins, lambda x: x.bitwiseAND(F.col("low")))))
    steps = F.transform("at", lambda x, i: F.least(F.coalesce(F.get("at", i + 1) - x, F.lit(3)), F.lit(3)).cast("long"))
    return d.withColumn("n_repeat_words", total(steps)).drop("bits", "low", "high", "keys", "at")


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``words``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``.

    A null or blank text has no words: all counts but the symbols are 0, and it fails the base rules.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", text.alias("text")).withColumn("words", words_of(F.col("text")))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = _repeat_words(d.withColumn("lines", lines))
    return d.select(
        "doc_id",
        "words",
        "n_words",
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _grams(words: Column, buckets: int) -> Column:
    """Bucket of each word and of each two words in a row (the last word is paired with nothing)."""
    of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return F.flatten(F.transform(words, lambda w, i: F.array(of(w), of(w, F.coalesce(F.get(words, i + 1), F.lit(""))))))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, limit: int = TRUSTED) -> list[float]:
    """For each bucket, log of its smoothed share in the target over that in the corpus; 0 for buckets without a gram.

    trusted: ``doc_id`` of trusted documents. The corpus is counted whole; the target is fitted on ``limit`` trusted
    documents at most. Counts are summed map-side, so what is shuffled and collected is two numbers a bucket.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumn("target", F.lit(1))
    d = docs.select("doc_id", words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    d = d.join(F.broadcast(ids), "doc_id", "left")  # bounded by limit
    grams = d.select("target", F.explode(_grams(F.col("words"), buckets)).alias("b"))
    counted = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("target")).collect()
    table = [0.0] * buckets
    all_raw, all_target = sum(r for _, r, _ in counted), sum(t for _, _, t in counted)
    for b, r, t in counted if all_target else []:
        table[b] = math.log((t * all_raw / r + smoothing) / (all_target + smoothing))
    return table


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Base counts, ``score`` (mean log ratio over the grams; 0 without words), ``base_failed`` and ``kept`` for each document.

    Without any trusted document all scores are 0, and the base rules alone decide (for thresholds up to 0).
    """
    table = constant_array(log_ratios(docs, trusted, buckets))
    d = base_counts(docs)
    of = lambda *c: F.get(table, F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int"))
    pairs = F.transform("words", lambda w, i: of(w) + of(w, F.coalesce(F.get("words", i + 1), F.lit(""))))
    score = F.when(F.col("n_words") > 0, total(pairs, "double") / (2 * F.col("n_words"))).otherwise(F.lit(0.0))
    d = d.withColumn("score", score).drop("words")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
