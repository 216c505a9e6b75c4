import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SCHEMA, clash, empty, rows

from edgeloom.llm import langid, tokens

SYLLABLES = {"aa": ["the", "of", "and", "ing", "er"], "bb": ["ção", "não", "que", "em", "os"], "cc": ["der", "schl", "ung", "ein", "ü"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_gradients():
    net = langid.fresh(["a", "b", "c"], 4, 1)
    rng = np.random.default_rng(0)
    x, y, mask = rng.integers(0, 256, (6, 5)), np.array([0, 1, 2, 1, 0]), np.ones((6, 5), "f4")
    mask[4:, 1] = 0
    _, grads = langid.loss_and_gradients(net, x, y, mask)
    for p, g in zip(net.params(), grads, strict=True):
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        p[at] += 1e-2
        high = langid.loss_and_gradients(net, x, y, mask)[0]
        p[at] -= 2e-2
        low = langid.loss_and_gradients(net, x, y, mask)[0]
        p[at] += 1e-2
        assert (high - low) / 2e-2 == pytest.approx(g[at], rel=2e-2)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    data = [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([2, 20, 300])), lang, "s", 0) for i in range(400)]
    data += [(900, None, "aa", "s", 0), (901, "12 !? ² ½ Ⅷ", "bb", "s", 0), (902, "", None, "s", 0), (None, text(rng, "cc", 30), "cc", None, None), (903, text(rng, "bb", 30_000), None, "s", 0)]
    return spark.createDataFrame(data, SCHEMA)


def test_held_out_accuracy(spark, labelled):
    net = langid.fit(labelled, steps=120)
    got = langid.identify(clash(labelled).withColumn("lang_pred", langid.F.lit(3)), net)
    assert got.columns.count("score") == got.columns.count("lang_pred") == 1
    out = rows(got.select("doc_id", "lang", "lang_pred", "score", langid.held_out(got["doc_id"])))
    assert len(out) == 405 and all(0 <= s <= 1 for *_, s, _ in out)
    held = [(a, b) for d, a, b, _, h in out if h and a and b != "und"]
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, *_, h in out)
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    named = {d: (b, s) for d, _, b, s, _ in out}
    assert named[900] == named[901] == named[902] == ("und", 0.0) and named[903][0] == "bb" and named[None][0] == "cc"


def test_fit_repeats_and_ignores_held_out(spark, labelled):
    a, b = (langid.sample_windows(labelled) for _ in range(2))
    assert a == b
    held = labelled.withColumn("lang", langid.F.when(langid.held_out(labelled["doc_id"]), "zz").otherwise(labelled["lang"]))
    assert langid.sample_windows(held) == a


def test_whole_text_counts():
    net = langid.fresh(["a", "b"], 4, 2)
    whole = langid.predict(net, [b"abc" * 100, b"", b"x"])
    assert whole[1].sum() == 0 and whole[0].sum() == pytest.approx(1) and whole[2].sum() == pytest.approx(1)
    again = langid.predict(net, [b"abc" * 100], block=2)
    assert np.allclose(whole[0], again[0], atol=1e-5)


def test_without_labels(spark):
    assert langid.fit(empty(spark)) is None
    assert langid.identify(empty(spark), None).count() == 0
    d = spark.createDataFrame([(1, "text", None, None, 4)], SCHEMA)
    assert rows(langid.identify(d, langid.fit(d)), "lang_pred", "score") == [("und", 0.0)]


def test_sample_is_the_smallest_hashes(spark, labelled):
    """The bound on hashes before the ranking changes nothing but the work."""
    few = langid.sample_windows(labelled, per_language=5)
    ids = labelled.where("lang is not null and text is not null and doc_id is not null").where(~langid.held_out(labelled["doc_id"]))
    by = {}
    for d, y, t in rows(ids.orderBy(langid.F.xxhash64("doc_id")), "doc_id", "lang", "text"):
        by.setdefault(y, []).append(t)
    want = {y: set(ts[:5]) for y, ts in by.items()}
    assert all(any(raw in t.encode() for t in want[y]) for raw, y in zip(*few, strict=True))


def test_names_of_the_outputs(spark, labelled):
    docs = clash(labelled)
    got = langid.identify(docs, None, names=("__a", "__b"))
    assert got.columns == [*docs.columns, "__a", "__b"]


def test_worker_holds_few_rows_and_no_tokenizer():
    tokens.word_tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode(["left by a stage before"])
    n = 2 * langid.ROWS + 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if i % 5 == 0 else f"the of {i}" for i in range(n)])], names=["doc_id", "__text"])
    net = langid.fresh(["a", "b"], 4, 1)
    out = list(langid.named(net, iter([batch, batch.slice(0, 0)]), ["doc_id", "language", "certainty"]))
    assert not tokens._LOADED
    assert max(b.num_rows for b in out) <= langid.ROWS
    got = pa.Table.from_batches(out).to_pydict()
    assert got["doc_id"] == list(range(n))
    assert [x == "und" for x in got["language"]] == [i % 5 == 0 for i in range(n)]
    (whole,) = langid.predict(net, [f"the of {n - 1}".encode()])
    assert got["certainty"][-1] == pytest.approx(whole.max(), rel=1e-5)
