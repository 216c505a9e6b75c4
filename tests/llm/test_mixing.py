import numpy as np
import pytest
from helpers import AWKWARD, SCHEMA, clash, corpus, empty, rows, words

from edgeloom.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Excess over the caps reshared by weight, again and again."""
    total, goal = sum(sizes), [0.0] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    open_, left = set(range(len(sizes))), float(total)
    while open_:
        level = left / sum(w[i] for i in open_)
        over = {i for i in open_ if level * w[i] >= most * sizes[i]}
        if not over:
            for i in open_:
                goal[i] = level * w[i]
            break
        for i in over:
            goal[i] = float(most * sizes[i])
            left -= goal[i]
        open_ -= over
    return goal


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1, 1000], [10, 0, 500, 3, 70, 0], [5], [0, 0], [7, 900, 2, 2, 2, 2, 4000]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"0s{i}", n) for i, n in enumerate(sizes)], "skey string, source_size long")
    got = [r[0] for r in mixing.targets(df).orderBy("skey").select("target").collect()]
    assert got == pytest.approx(brute_targets(sizes)) and sum(got) == pytest.approx(sum(sizes))


def test_split_quotas():
    quotas = np.array([1000, 3, 0, 250, 17])
    parts = mixing.split_quotas(quotas, 7, 5)
    assert (parts.sum(axis=0) == quotas).all() and np.ptp(parts.sum(axis=1)) <= 1
    assert (parts == mixing.split_quotas(quotas, 7, 5)).all() and (parts != mixing.split_quotas(quotas, 7, 6)).any()
    many = np.array([mixing.split_quotas(np.array([60, 40]), 4, s)[0, 0] for s in range(300)])
    assert abs(many.mean() - 15) < 0.6 and many.std() > 1  # hypergeometric: mean 15, deviation 2.1


def test_mix(spark):
    docs = corpus(spark, 400, extra=[(7, "x y", None, "a"), (7, "x y", None, "a")])
    got = rows(mixing.mix(clash(docs)), "doc_id", "source", "size", "source_size", "target", "taken", "draws")
    data = rows(docs, "doc_id", "source", "text")
    assert sorted((d, s or "", n) for d, s, n, *_ in got) == sorted((d, s or "", len(words(t))) for d, s, t in data)
    sizes = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = dict(zip(order, brute_targets([sizes[s] for s in order]), strict=True))
    taken = dict.fromkeys(sizes, 0)
    for _, s, n, size, target, took, draws in got:
        assert size == sizes[s] and target == pytest.approx(goal[s]) and took <= 3 * n and took == n * len(draws)
        assert len({x.epoch for x in draws}) == len(draws) and all(0 <= x.shard < mixing.SHARDS for x in draws)
        taken[s] += took
    for s in sizes:
        longest = max(len(words(t)) for _, x, t in data if x == s)
        assert abs(taken[s] - goal[s]) <= longest / 2 + 1
    again = rows(mixing.mix(docs.repartition(5)), "doc_id", "source", "size", "source_size", "target", "taken", "draws")
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_awkward(spark):
    assert mixing.mix(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None), (None, "", None, "a", 0)], SCHEMA)
    assert sorted(r[5] for r in rows(mixing.mix(nothing))) == [0, 0]
    assert mixing.mix(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(AWKWARD)], SCHEMA)).count() == len(AWKWARD)


def test_mixed_documents(spark):
    docs = corpus(spark, 100)
    taken = {r[0]: len(r[1]) for r in rows(mixing.mix(docs), "doc_id", "draws")}
    got = {}
    out = mixing.mixed_documents(docs)
    for (d,) in rows(out, "doc_id"):
        got[d] = got.get(d, 0) + 1
    assert got == {d: n for d, n in taken.items() if n} and out.columns == docs.columns


def test_mixed_documents_by_row(spark):
    """Rows without an id stay in the mix; rows that share an id come as often as each was drawn; equal rows too."""
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    data = [(None if i % 2 else i, text(i, 5 + i % 40), None, "a" if i % 3 else "b", i) for i in range(300)]
    data += [(7000, text(900 + i, 30 + i), None, ("a", "b", "c")[i % 3], i) for i in range(30)]
    data += [(None, "same text", None, "b", 1)] * 5 + [(8000, "same row", None, "b", 1)] * 4
    docs = spark.createDataFrame(data, SCHEMA)
    want, draws = {}, {}
    for t, x in rows(mixing.mix(docs, carry=["text"]), "text", "draws"):
        want[t] = want.get(t, 0) + len(x)
        draws.setdefault(t, []).append(len(x))
    got = {}
    for (t,) in rows(mixing.mixed_documents(docs), "text"):
        got[t] = got.get(t, 0) + 1
    assert got == {t: n for t, n in want.items() if n}
    shared = {draws[text(900 + i, 30 + i)][0] for i in range(30)}
    assert len(shared) > 1 and any(r[0] is None for r in rows(mixing.mixed_documents(docs), "doc_id"))
