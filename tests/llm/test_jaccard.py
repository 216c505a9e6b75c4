import random

import numpy as np
import pytest
from helpers import SCHEMA, clash, corpus, empty, jaccard, prose, rows, shingles

from edgeloom.llm import jaccard_join as jj


def brute(data):
    """doc_id: (set size, smallest id reachable) by comparing all pairs."""
    sets = {}
    for d, t in data:
        sets.setdefault(d, []).append(shingles(t))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(d, s) for d, ss in sets.items() for s in ss if s]
    for i, (d, s) in enumerate(flat):
        for e, t in flat[:i]:
            if 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return sorted((d, len(shingles(t)), find(d)) for d, t in data)


def test_components_equal_brute_force(spark):
    docs = corpus(spark, 220, seed=7, extra=[(5, "one id, another text", None, None), (1000, "A b C d", None, None), (1500, "a B c D", None, None)])
    got = sorted(rows(jj.linked_components(clash(docs)), "doc_id", "n_shingles", "component_id"))
    assert got == brute(rows(docs, "doc_id", "text"))


def test_chains_and_large_groups(spark):
    """A chain of edits drifts away from its start, and a passage that all texts quote links none of them."""
    rng = random.Random(3)
    w = prose(rng, 120, 5000).split()
    data = []
    for i in range(60):
        data.append((i, " ".join(w)))
        w[rng.randrange(len(w))] = f"e{i}"
    passage = prose(rng, 60, 5000)
    data += [(100 + i, f"{prose(rng, 150, 5000)} {passage} {prose(rng, 100, 5000)}") for i in range(90)]
    data += [(300 + i, passage + f" x{i}") for i in range(30)]
    rng.shuffle(data)
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in data], SCHEMA)
    got = sorted(rows(jj.linked_components(docs, small_group=8), "doc_id", "n_shingles", "component_id"))
    assert got == brute(data)


def test_awkward(spark):
    assert jj.linked_components(empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b c", None, None, 0), (2, "a b c", None, None, 0), (1, "A\tB\nC", None, None, 0), (2, "a b c", None, None, 0), (4, None, None, None, None), (3, " ", None, None, 0)], SCHEMA)
    got = rows(jj.linked_components(docs), "doc_id", "n_shingles", "component_id")
    assert sorted(got, key=str) == sorted([(None, 1, None), (2, 1, 1), (1, 1, 1), (2, 1, 1), (4, 0, 4), (3, 0, 3)], key=str)


def test_shingle_sets():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in range(12)] + ["", " \n", "A b", "a a a a a a a a"]
    owner, h = jj.shingle_sets([t.encode() for t in texts])
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]
    one = {x for i, x in zip(owner, h, strict=True) if i == 9}
    assert one == set(jj.shingle_sets([texts[9].upper().encode()])[1])


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold(seed):
    """Links share a key, and sketches never differ in more bits than the sets in members."""
    rng = random.Random(seed)
    for n in (5, 6, 9, 14, 30, 90, 400):
        for _ in range(12):
            w = prose(rng, n + 4, 10_000).split()
            x = list(w)
            for _ in range(rng.randrange(1, 1 + max(1, n // 40))):
                x[rng.choice([0, len(x) - 1, rng.randrange(len(x))])] = "new"
            a, b = " ".join(w), " ".join(x)
            sets = [jj.shingle_sets([t.encode()])[1] for t in (a, b)]
            different = len(np.setxor1d(*sets))
            assert jj.sketch_distance(*(jj.bit_sketch(s) for s in sets)) <= different
            if jaccard(shingles(a), shingles(b)) >= 0.8:
                keys = [set(jj.part_keys(np.zeros(len(s), np.int64), s, np.array([len(s)]))[2].tolist()) for s in sets]
                assert keys[0] & keys[1]


def test_passage_in_short_texts(spark):
    """A passage that makes up most of 700 short texts, some of them near copies; the index alone tells most apart."""
    rng = random.Random(11)
    passage = prose(rng, 40, 5000).split()
    data = []
    for i in range(700):
        if i and rng.random() < 0.2:
            w = rng.choice(data)[1].split(" ")
            w[rng.randrange(len(w))] = f"n{i}"
        else:
            w = [f"a{rng.randrange(10**6)}" for _ in range(rng.choice([2, 6, 10, 20, 40]))] + passage
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in data], SCHEMA)
    got = {tuple(r) for r in rows(jj.linked_components(docs, group_block=97), "doc_id", "n_shingles", "component_id")}
    assert got == set(brute(data))


def test_cluster_of_near_copies(spark):
    """Copies with many edits each: links among some, none among others, all in the same large groups."""
    rng = random.Random(5)
    base = prose(rng, 150, 5000).split()
    data = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in data], SCHEMA)
    got = sorted(rows(jj.linked_components(docs, group_block=64), "doc_id", "n_shingles", "component_id"))
    assert got == brute(data)
    assert len({c for *_, c in got}) > 5


def test_index_keeps_a_key_of_every_link():
    """Of all keys in one order, the rarest that the index keeps of two linked sets share one in a band of both."""
    rng = random.Random(9)
    base = [prose(rng, 150, 5000).split() for _ in range(3)]
    texts = []
    for i in range(150):
        w = list(base[i % 3])
        for _ in range(rng.randrange(10)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    owner, h = jj.shingle_sets([t.encode() for t in texts])
    n, _ = jj.set_digests(owner, h, len(texts))
    who, lower, key = jj.part_keys(owner, h, n)
    filled, spare = jj.part_counts(owner, h, n)
    holders = {}
    for k in key.tolist():
        holders[k] = holders.get(k, 0) + 1
    index = [set() for _ in texts]
    for i in range(len(texts)):
        for low in (0, 1):
            mine = sorted(key[(who == i) & (lower == low)].tolist(), key=lambda k: (-holders[k], k))
            assert len(mine) == filled[low][i]
            index[i] |= set(mine[spare[low][i] :])
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(linked) > 100
    assert all(index[i] & index[j] for i, j in linked)


def test_bands_cover_partners():
    for n in range(1, 3000):
        own = jj.band_of(n)
        assert jj.band_start(own) <= n < jj.band_start(own + 1)
        most = n * 100 // 80
        assert jj.band_of(most) - own <= 1
        k, d = jj.parts_of(own)
        assert d >= jj.most_different(n + most) and k > d
