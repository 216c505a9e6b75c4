import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import clash, corpus, empty, rows
from tokenizers import Tokenizer

from edgeloom.llm import packing
from edgeloom.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_nnls_against_conditions():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((8, 14)), rng.random(8)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-5).all() and (abs(slope[x > 1e-9]) < 1e-5).all()


def best_fit(histogram, capacity):
    """Sequences that best fit in descending order takes."""
    slack = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        i = bisect.bisect_left(slack, n)
        rest = (slack.pop(i) if i < len(slack) else capacity) - n
        bisect.insort(slack, rest)
    return len(slack)


@pytest.mark.parametrize("grain,share", [(1, 0.75), (8, 0.75), (4, 0.5)])
def test_plan_places_everything_once(grain, share):
    rng = random.Random(4)
    histogram = {n: rng.randrange(1, 60) for n in rng.sample(range(1, 257), 120)} | {256: 9}
    runs, used = packing.plan(histogram, 256, grain, 3, share)
    spans = {}
    for n, rs in runs.items():
        assert sum(c for c, _, _ in rs) == histogram[n]
        for count, first, offset in rs:
            for s in range(first, first + count):
                spans.setdefault(s, []).append((offset, n))
    assert sorted(spans) == list(range(used))
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.best_plan(histogram, 256, grain, 3)[1] <= min(used, 1.01 * best_fit(histogram, 256) + 2)


def test_cached_encoding_equals_the_library():
    tok = WordTokenizer(PATH, cache_items=50)
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .,!?'sté1́\ń<|İΣक़") for _ in range(50)) for _ in range(500)]
    texts += ["don't we'll 'S <|endoftext|>a.<|startoftext|> x", "a\x1cb", "...a ..!? .,x ,.", "", "क़ख़ ﬁ ½ 12ab3", "日本語。はい", "a​b c　d\x85e"]
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in plain.encode_batch(part, add_special_tokens=False)]
        assert tok.encode(part) == want


def test_words_are_learned_once():
    """Forms of a word that have the same ids are one item, and punctuation that clings to a word is no new one."""
    tok, plain, learned = WordTokenizer(PATH), Tokenizer.from_file(PATH), []
    learn = tok._learn
    tok._learn = lambda items: learned.extend(items) or learn(items)
    texts = ["Straße Word word. word, WORD!", "word? STRAßE... word.", "word <|ENDOFTEXT|> <|endoftext|> WORD", "I'S 'LL ÀÉ Ĳ İ", "Σας ΣΑΣ. Word"]
    for t in texts:
        assert tok.encode([t]) == [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    for t in texts[:2] * 2:
        tok.encode([t])
    assert len(learned) == len(set(learned))
    first = WordTokenizer(PATH)
    first.encode(texts[:2])
    assert set(first.young) == {"straße", "word", ".", ",", "!", "?", "..."}


def test_pack(spark):
    docs = corpus(spark)
    got = rows(packing.pack(clash(docs), PATH, capacity=64), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    plain = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows(docs, "doc_id", "text"):
        ids = np.asarray([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted(r[:5] for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r[5], []).append((r[6], r[3]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by_sequence) <= 1.02 * sum(r[3] for r in got) / 64 + 2


def test_ties_nulls_and_nothing(spark):
    assert packing.pack(empty(spark), PATH).count() == 0
    docs = corpus(spark, 5, extra=[(None, "no id", None, None), (3, "same", None, None), (3, "same", None, None)])
    got = rows(packing.pack(docs, PATH), "doc_id", "sequence_id", "offset")
    assert len(set(got)) == len(got) and sum(r[0] is None for r in got) == 1
