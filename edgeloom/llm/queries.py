"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import fingerprints, jaccard_join, langid, lines, mixing, packing, quality, shuffle, substrings, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    out = langid.identify(docs, langid.fit(docs), carry=["doc_id"])
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    trusted = _table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return quality.quality_rules(_table(spark, sf, "documents"), trusted)


def op4_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked_components(_table(spark, sf, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    d = fingerprints.fingerprint_pairs(_table(spark, sf, "documents"))
    like = lambda other: fingerprints.likeness(F.col("sketch"), F.col(other))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.packed_string(F.col("sketch")).alias("fingerprint"),
        fingerprints.packed_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        like("edited_sketch").alias("near_edited"),
        like("next_sketch").alias("near_next"),
    )


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_report(_table(spark, sf, "documents"))


def op7_training_order(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    folder = shuffle.shared_folder(docs, "training-order")
    return shuffle.materialize(docs, public_tokenizers.path("word_bpe_49k.json"), folder, seed=1).withColumn("folder", F.lit(folder))


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.repeated_spans(_table(spark, sf, "documents"), runs=True)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_language_id, op3_quality_rules, op4_ngram_jaccard_join, op5_document_fingerprints, op6_line_dedup,
    op7_training_order, op8_substring_dedup, op9_token_counts, op10_source_mixing,
)} | {"pipeline": corpus_pipeline.run}

WORD_SQL = r"[^\x20\x09-\x0D]+"

OP4_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}') AS ws FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM w WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT u, v FROM c JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * both_ >= {jaccard_join.PERCENT} * (x.n + y.n - both_)),
    e AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
    cc(node, label) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM e GROUP BY u
      UNION SELECT e.v, min(cc.label) FROM cc JOIN e ON e.u = cc.node JOIN recurring.cc AS old ON old.node = e.v WHERE cc.label < old.label GROUP BY e.v)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(cc.label, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN cc ON cc.node = d.doc_id"""

OP10_SQL = rf"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) AS size,
      CASE WHEN doc_id IS NULL THEN md5('0::' || md5(coalesce(text, ''))) ELSE md5('0:' || doc_id::VARCHAR) END AS pkey FROM documents),
    s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
    a AS (SELECT skey, source_size, {list(mixing.WEIGHTS)}[((row_number() OVER (ORDER BY skey) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS weight, ({mixing.MAX_REPEATS} * source_size)::DOUBLE AS cap FROM s),
    b AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS total, sum(cap) OVER o - cap AS capped, (SELECT sum(weight) FROM a) - sum(weight) OVER o + weight AS rest_ FROM a WINDOW o AS (ORDER BY cap / weight, skey)),
    l AS (SELECT *, (total - capped) / rest_ AS level FROM b),
    t AS (SELECT arg_min(level, (cap / weight, skey)) FILTER (cap > level * weight) AS at_ FROM l),
    g AS (SELECT skey, source_size, CASE WHEN at_ IS NULL THEN cap ELSE least(cap, at_ * weight) END AS target FROM l, t),
    h AS (SELECT *, greatest({mixing.MIN_BLOCKS}, ceil(source_size / {mixing.BLOCK_WORDS}.0))::BIGINT AS blocks, CASE WHEN source_size > 0 THEN least({mixing.MAX_REPEATS}, floor(target / source_size + 1e-9))::BIGINT ELSE 0 END AS whole FROM g),
    r AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest FROM h),
    p AS (SELECT d.doc_id, d.size, d.pkey, r.*, (('0x' || substr(pkey, 1, 8))::BIGINT * blocks) >> 32 AS block FROM d JOIN r USING (skey)),
    w AS (SELECT skey, block, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY skey ORDER BY block) - sum(size) AS begins FROM p GROUP BY skey, block),
    x AS (SELECT p.*, begins, words, sum(size) OVER (PARTITION BY skey, block ORDER BY pkey, doc_id, size ROWS UNBOUNDED PRECEDING) AS local FROM p JOIN w USING (skey, block))
    SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN begins + words <= rest OR (begins < rest AND begins + local - size / 2.0 <= rest) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x"""

ORACLE: dict[str, str] = {"op4_ngram_jaccard_join": OP4_SQL, "op10_source_mixing": OP10_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
