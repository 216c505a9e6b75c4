import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from helpers import AWKWARD, SCHEMA, clash, corpus, empty, rows
from tokenizers import Tokenizer

from edgeloom.llm import shuffle, substrings, token_counts, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts(spark):
    rng = random.Random(6)
    odd = [(5000 + i, "".join(rng.choice("ab  \n\t▁é日.<s>́") for _ in range(rng.randrange(40))), None, None) for i in range(300)]
    docs = corpus(spark, extra=[*odd, (3, "again", None, None), (3, "again", None, None), (None, "no id", None, None)])
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(((d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for d, t in rows(docs, "doc_id", "text")), key=str)
    for frequent in (1, 50, 100_000):
        got = rows(token_counts.count_tokens(clash(docs), MODEL, frequent=frequent), "doc_id", "n_bytes", "n_tokens", "over_limit")
        assert sorted(got, key=str) == want
    assert token_counts.count_tokens(empty(spark), MODEL).count() == 0


def test_repeated_sentences(spark):
    s = ["The quick brown fox jumps over the lazy dog today.", "Another sentence that has more than eight words in it!", "Short one."]
    data = [(2, f"start {s[0]} {s[1]} x"), (1, f"{s[1]}\nzzz {s[2]}"), (3, f"{s[2]} And {s[0]} The  QUICK brown fox jumps over the lazy dog today. end"), (4, None), (None, s[1])]
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in data], SCHEMA)
    got = sorted((r[:6] for r in rows(substrings.repeated_spans(clash(docs)))), key=str)
    texts = dict(data)
    quick, other = "The  QUICK brown fox jumps over the lazy dog today.", s[1]
    want = [(2, texts[2].index(other), texts[2].index(other) + len(other), 10, 1, 0), (None, 0, len(other), 10, 1, 0)]
    assert got == sorted(want, key=str)
    docs = spark.createDataFrame([(1, f"{s[0]} {s[1]} {s[2]}", None, None, 0), (2, f"a b. {s[0]} c\n{quick} {s[1]}", None, None, 0)], SCHEMA)
    spans = substrings.repeated_spans(docs)
    text = f"a b. {s[0]} c\n{quick} {s[1]}"
    assert sorted(text[a:b] for d, a, b, *_ in rows(spans)) == sorted([s[0], quick, s[1]])
    left = {r[0]: r[1] for r in rows(substrings.remove_spans(docs, spans), "doc_id", "text")}
    assert left == {1: f"{s[0]} {s[1]} {s[2]}", 2: "a b.  c\n "}


def test_spans_against_brute_force(spark):
    docs = corpus(spark, 200)
    for unit in substrings.UNITS:
        seen, want = {}, set()
        for d, t in sorted(rows(docs, "doc_id", "text")):
            for m in substrings.UNITS[unit].finditer(t or ""):
                key = substrings.normalize(m[0])
                if len(key.split()) >= 8:
                    at = (d, m.start() + len(m[0]) - len(m[0].lstrip()))
                    if key in seen:
                        want.add((*at, m.end(), *seen[key]))
                    seen.setdefault(key, at)
        got = {(r[0], r[1], r[2], r[4], r[5]) for r in rows(substrings.repeated_spans(docs, unit))}
        assert got == want
    assert substrings.repeated_spans(empty(spark)).count() == 0


def test_runs_of_short_sentences(spark):
    """Short sentences inside a repeated passage are found with their neighbours, those that recur alone are not."""
    long = "This sentence has quite a few more than eight words in it."
    passage = f"Short one. {long} Yes it is. Two of them here. And a third. Done."
    data = [(1, f"Own words. {passage} Other."), (2, f"Something else stands here. {passage} Unlike."), (3, "Yes it is. A new beginning here. Nothing more. Done. What else is there?")]
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in data], SCHEMA)
    texts, covered = dict(data), {d: set() for d, _ in data}
    for d, a, b, n, kept, at, _ in rows(substrings.repeated_spans(docs, runs=True)):
        assert substrings.normalize(texts[kept][at:]).startswith(substrings.normalize(texts[d][a:b])) and n >= 8
        covered[d] |= set(range(a, b))
    a = texts[2].index(passage)
    assert not covered[1] and not covered[3] and covered[2] == set(range(a, a + len(passage)))
    plain = rows(substrings.repeated_spans(docs), "doc_id")
    assert plain == [(2,)]
    same = spark.createDataFrame([(1, "Ha. " * 20, None, None, 0)], SCHEMA)
    left = rows(substrings.remove_spans(same, substrings.repeated_spans(same, runs=True)), "text")[0][0]
    assert left.split() == ["Ha."] * 8


def test_spans_of_rows_that_share_an_id(spark):
    """Rows without an id, and texts that share one, lose their own spans only; other rows stay whole."""
    a, b = "This sentence has quite a few more than eight words in it.", "And here is another one that is also long enough for that."
    data = [(1, f"{a} One."), (2, f"Two. {a}"), (2, f"{b} x y z and some unrelated words that stay."), (None, f"{a} Four."), (None, f"q. {b}"), (3, f"{b} tail")]
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in data], SCHEMA)
    spans = substrings.repeated_spans(docs)
    got = sorted(rows(substrings.remove_spans(clash(docs), spans), "doc_id", "text"), key=str)
    kept = [t for _, t in got]
    assert len(got) == 6 and (1, f"{a} One.") in got and sum(a in t for t in kept) == 1 and sum(b in t for t in kept) == 1
    assert (None, " Four.") in got and (3, " tail") in got


def test_long_pre_tokens(spark):
    """Pre-tokens too long for the broadcast table are counted all the same, and a second call does not read the first one's table."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for texts in (["x" * 500, "abc " * 30 + "y" * 3000], ["abc " * 10, "x" * 500 + " abc"]):
        docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts * 3)], SCHEMA)
        got = dict(rows(token_counts.count_tokens(docs, MODEL), "doc_id", "n_tokens"))
        assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts * 3)}


def test_tokenizers_that_part_texts_otherwise():
    """A tokenizer that does not part texts as the cache does is asked for whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, plain = tokens.WordTokenizer(path), Tokenizer.from_file(path)
    texts = [t or "" for t in AWKWARD] + ["Some plain words, and more."]
    assert not tok.apart and [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_feistel():
    for n in (1, 2, 3, 10, 257, 5000):
        f = shuffle.Feistel(n, 9)
        slots = f.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.numbers(slots) == np.arange(n)).all()
    a, b = shuffle.Feistel(5000, 1).slots(np.arange(5000)), shuffle.Feistel(5000, 2).slots(np.arange(5000))
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.06


def test_rounds_open_their_own_documents_only():
    rng = np.random.default_rng(3)
    k = rng.integers(1, 4, 700)
    of = np.repeat(np.arange(700), k)
    records = [rng.bytes(6) for _ in of]
    blobs = [b"".join(r for r, d in zip(records, of, strict=True) if d == i) for i in range(700)]
    mine, opened = rng.random(len(of)) < 0.2, []
    mine[of < 256] &= of[of < 256] == 9  # of the first documents one at most
    got = list(shuffle.opened_records(pa.array(blobs), of, mine, 6, lambda b: opened.append(b) or b))
    assert b"".join(x for x, _, _ in got) == b"".join(r for r, m in zip(records, mine, strict=True) if m)
    assert [(i, j) for _, i, j in got] == [(int(np.searchsorted(of, a)), int(np.searchsorted(of, a + 256))) for a in (0, 256, 512)]
    assert opened == [blobs[i] for i in np.unique(of[mine])]
    assert not any(x for x, _, _ in shuffle.opened_records(pa.array(blobs), of, mine & False, 6, None))


def test_items_of_other_scripts():
    tok = tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one.,two one., two.?! a. 1. x1. ß! µm. ª. абв. слово word 日本. x.日 İx. Don't. e\x1cf.", "абв где", "ªb ºc ĸ ŉ. ǅ ɐ."]
    assert tok.encode(texts) == tok._whole(texts)


def test_training_order_round_trip(spark, tmp_path):
    docs = corpus(spark, 60, extra=[(None, "no id", None, None), (1001, "", None, None)])
    path = str(tmp_path / "order")
    index = rows(shuffle.materialize(clash(docs), WORDS, path, seed=3, record_ids=16, shard_records=100))
    total = len(index)
    assert sorted(r[3] for r in index) == list(range(total)) and sorted(r[2] for r in index) == list(range(total))
    read = list(shuffle.read_records(spark, path))
    assert len(read) == total == len(list(shuffle.read_records(spark, path, 0, total + 5)))
    tail = list(shuffle.read_records(spark, path, 150, 30))
    assert all((a == b).all() for a, b in zip(tail, read[150:180], strict=True))
    tok = Tokenizer.from_file(WORDS)
    by_number = {}
    for doc, piece, number, slot, shard, position, crc in index:
        assert shard == slot // 100 and position == slot % 100 * 33 and zlib.crc32(read[slot].tobytes()) == crc
        by_number[number] = (doc, piece, read[slot])
    stream, got = [], []
    for number in range(total):
        doc, piece, ids = by_number[number]
        if piece == 0:
            got.append((doc, stream := []))
        stream += ids.tolist()
    want = []
    for doc, text in rows(docs, "doc_id", "text"):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc, ids + [0] * (16 - len(ids) % 16)))
    assert sorted(got, key=str) == sorted(want, key=str)
    again = rows(shuffle.materialize(docs.repartition(5), WORDS, str(tmp_path / "again"), seed=3, record_ids=16, shard_records=100))
    assert sorted(again, key=str) == sorted(index, key=str)
    files = sorted((tmp_path / "order").glob("shards-*/part-*"))
    assert [f.stat().st_size for f in files] == [33 * 100] * (total // 100) + [33 * (total % 100)] * (total % 100 > 0)
    assert shuffle.materialize(empty(spark), WORDS, str(tmp_path / "none")).count() == 0
    assert list(shuffle.read_records(spark, str(tmp_path / "none"))) == []


def test_ids_of_four_bytes(spark, tmp_path, monkeypatch):
    """Vocabularies beyond two bytes get four; ids that hold line ends or any other byte stay whole."""
    docs = corpus(spark, 40)
    monkeypatch.setattr(shuffle, "id_bytes", lambda tokenizer: 4)
    index = rows(shuffle.materialize(docs, WORDS, str(tmp_path / "four"), record_ids=64, shard_records=50), "slot", "position", "crc32")
    read = list(shuffle.read_records(spark, str(tmp_path / "four")))
    assert {len(r.tobytes()) for r in read} == {256}
    assert all(zlib.crc32(read[slot].tobytes()) == crc and position == slot % 50 * 257 for slot, position, crc in index)
    assert any(b"\n" in r.tobytes() for r in read)


def test_awkward_records(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(AWKWARD)], SCHEMA)
    assert {r[0] for r in rows(shuffle.materialize(docs, WORDS, str(tmp_path / "o")))} == set(range(len(AWKWARD)))
