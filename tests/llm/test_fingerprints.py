import hashlib
import random
import struct

import numpy as np
import xxhash
from helpers import SCHEMA, clash, corpus, empty, jaccard, prose, rows, shingles
from pyspark.sql import functions as F

from edgeloom.llm import fingerprints as fp
from edgeloom.llm import queries


def run(spark, docs, tmp_path, name):
    docs.write.mode("overwrite").parquet(str(tmp_path / name / "documents.parquet"))
    return queries.op5_document_fingerprints(spark, str(tmp_path / name))


def test_query(spark, tmp_path):
    docs = corpus(spark, 150, extra=[(5, "an id twice", None, None)])
    got = rows(run(spark, clash(docs), tmp_path, "a"))
    data = sorted(((d, t or "") for d, t in rows(docs, "doc_id", "text")))
    assert sorted(r[0] for r in got) == [d for d, _ in data]
    by_text, errors = {}, []
    unique = {d: t for d, t in data if d != 5}
    order = [d for d, _ in data]
    for d, n_chars, sha, f, edited_f, near_edited, near_next in got:
        if d in (4, 5):
            continue
        text = unique[d]
        after = data[(order.index(d) + 1) % len(data)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        assert n_chars == len(text) and sha == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, f) == f and by_text.setdefault(edited, edited_f) == edited_f
        assert 0 <= near_edited <= 1 and 0 <= near_next <= 1
        errors += [abs(near_edited - jaccard(shingles(text, fold=False), shingles(edited, fold=False))), abs(near_next - jaccard(shingles(text, fold=False), shingles(after, fold=False)))]
    assert np.mean(errors) < 0.03 and np.quantile(errors, 0.99) < 0.2


def test_likeness_is_unbiased(spark):
    """Over many pairs of known similarity the mean estimate is near it."""
    pairs = []
    for i in range(200):
        a = [f"a{i}x{j}" for j in range(300)]
        b = a[:200] + [f"b{i}x{j}" for j in range(100)]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    df = fp.sketch(fp.sketch(df, "a", "sa"), "b", "sb").select(fp.likeness(F.col("sa"), F.col("sb")).alias("l"))
    got = [r[0] for r in df.collect()]
    want = 196 / (2 * 296 - 196)
    assert abs(np.mean(got) - want) < 0.015 and np.std(got) < 0.06


def test_densification_is_independent(spark):
    """Short texts leave most bins empty; what they borrow must not be all the same."""
    df = spark.createDataFrame([([f"w{j}" for j in range(12)],)], "words array<string>")
    (values,) = fp.sketch(df, "words", "s").head()["s"],
    assert len(values) == 256 and 4 <= len(set(values)) <= 8


def test_next_in_a_ring(spark):
    d = spark.range(0, 500).select((F.col("id") * 3).alias("doc_id"), F.col("id").alias("tie"), F.col("id").cast("string").alias("v"))
    for place_bytes in (1 << 20, 1, 0.2):
        got = {r["doc_id"]: r["next_v"] for r in fp.with_next(d.repartition(7), ["v"], place_bytes=place_bytes).collect()}
        assert got == {3 * i: str((i + 1) % 500) for i in range(500)}


def test_next_of_repeated_and_null_ids(spark):
    """Ids that make up much of a table are cut by their ties; the order is that of id and tie."""
    rng = random.Random(4)
    data = [(rng.choice([None, -5, 7, 7, 7, rng.randrange(-1000, 10**12)]), rng.randrange(-(2**63), 2**63)) for _ in range(900)]
    d = spark.createDataFrame([(i, t, f"{i}:{t}") for i, t in data], "doc_id long, tie long, v string")
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {f"{i}:{t}": f"{j}:{u}" for (i, t), (j, u) in zip(order, [*order[1:], order[0]], strict=True)}
    for place_bytes in (1 << 20, 1, 0.1):
        got = {r["v"]: r["next_v"] for r in fp.with_next(d.repartition(5), ["v"], place_bytes=place_bytes).collect()}
        assert got == want


def spark_hash(*values):
    h = 42
    for v in values:
        raw = struct.pack("<i", v) if isinstance(v, int) else v.encode()
        h = xxhash.xxh64(raw, seed=h).intdigest()
    return h


def brute_sketch(words, bins=256, tries=fp.TRIES):
    """The packed values by hand; hashes count as signed numbers wherever they are ordered."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    full = {}
    for h in sorted(signed(spark_hash(*g)) for g in grams):
        full.setdefault((h % (1 << 64)) >> 56, h)
    if not full:
        return None
    place, donors, out = list(full), fp.donor_orders(bins), []
    for b in range(bins):
        at = next((c for c in [b, *donors[b][:tries]] if c in full), None)
        if at is None:
            at = place[min((signed(spark_hash(b, c)) & -bins) | i for i, c in enumerate(place)) & (bins - 1)]
        out.append(full[at] & 255)
    return out


def test_sketches_equal_brute_force(spark):
    texts = [prose(random.Random(n), n, 5000).split() for n in (0, 1, 4, 5, 6, 12, 30, 36, 40, 60, 200, 700)]
    df = fp.sketch(spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "i int, words array<string>"), "words", "s")
    got = {r["i"]: r["s"] for r in df.collect()}
    assert got == {i: brute_sketch(w) for i, w in enumerate(texts)}


def test_alike_texts_borrow_alike(spark):
    """Texts of some 32 full bins and one word more: no switch of donors between them."""
    pairs = [([f"a{n}x{i}x{j}" for j in range(n)], [f"a{n}x{i}x{j}" for j in range(n + 1)]) for n in range(30, 46) for i in range(25)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    df = fp.sketch(fp.sketch(df, "a", "sa"), "b", "sb").select(fp.likeness(F.col("sa"), F.col("sb")).alias("l"), F.size("a").alias("n"))
    off = [abs(r["l"] - (r["n"] - 4) / (r["n"] - 3)) for r in df.collect()]
    assert max(off) < 0.15 and np.quantile(off, 0.95) < 0.08


def test_awkward(spark, tmp_path):
    assert run(spark, empty(spark), tmp_path, "none").count() == 0
    lone = spark.createDataFrame([(7, "a b c d e f", None, None, 0)], SCHEMA)
    (r,) = rows(run(spark, lone, tmp_path, "lone"))
    assert r[0] == 7 and r[6] == 1.0 and r[2] == hashlib.sha256(b"a b c a b c").hexdigest()
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "x", None, None, 1), (1, "", None, None, 0)], SCHEMA)
    got = rows(run(spark, nulls, tmp_path, "nulls"))
    assert len(got) == 3 and all(0 <= r[6] <= 1 for r in got)
