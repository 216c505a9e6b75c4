import collections
import math

import pytest
from helpers import AWKWARD, SCHEMA, clash, corpus, empty, rows, words

from edgeloom.llm import quality


def counts(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    seen = collections.Counter(windows)
    covered = {j for i, k in enumerate(windows) if seen[k] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    extra = [(1, "a b c a b c x a b c", None, None), (2, "a a a a a", None, None), (3, "a b a b a b", None, None), (4, "#x <y> |\n#x <y> |\n\n\n", None, None)]
    docs = corpus(spark, extra=extra)
    got = rows(quality.base_counts(clash(docs)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, text in rows(docs, "doc_id", "text"):
        c = counts(text)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(got) == sorted(want)


def test_log_ratios(spark):
    docs = spark.createDataFrame([(1, "a b a", None, None, 0), (2, "c", None, None, 0), (3, None, None, None, 0)], SCHEMA)
    trusted = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    table = quality.log_ratios(docs, trusted, buckets=1 << 12)
    grams = lambda t: [(x,) for x in t] + [(x, y) for x, y in zip(t, [*t[1:], ""], strict=True)]
    raw, target = collections.Counter(grams(["a", "b", "a"]) + grams(["c"])), collections.Counter(grams(["a", "b", "a"]))
    want = sorted(math.log((target[g] * 8 / raw[g] + quality.SMOOTHING) / (6 + quality.SMOOTHING)) for g in raw)
    assert sorted(x for x in table if x) == pytest.approx(want, rel=1e-9)


def test_verdicts(spark):
    good = ["alpha beta gamma delta " * 3 + f"w{i} " + " ".join(f"alpha{j % 7} beta{(i + j) % 11}" for j in range(40)) for i in range(30)]
    bad = [" ".join(f"alpha{j}### zeta{i * j}$$$" for j in range(60)) for i in range(10)]
    data = [(i, t, None, None, 0) for i, t in enumerate(good + bad)] + [(100 + i, t, None, None, 0) for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(data, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r[0]: r[1:] for r in rows(quality.quality_rules(docs, trusted), "doc_id", "base_failed", "kept", "score")}
    assert len(got) == len(data) and all(got[i][1] for i in range(30)) and not any(got[i][1] for i in range(30, 40))
    assert all(got[100 + i][:2] == (True, False) for i in range(len(AWKWARD)))
    again = {r[0]: r[1:] for r in rows(quality.quality_rules(docs.repartition(7), trusted), "doc_id", "base_failed", "kept", "score")}
    assert {k: v[:2] for k, v in again.items()} == {k: v[:2] for k, v in got.items()}


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.quality_rules(empty(spark), none).count() == 0
    assert {r[0] for r in rows(quality.quality_rules(corpus(spark, 5), none), "score")} == {0.0}
