"""The registered queries, with their production parameters, on small tables: against SQL, the libraries, or brute force."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import clash, corpus, rows, words
from tokenizers import Tokenizer

from edgeloom.llm import langid, queries, substrings
from edgeloom.llm import packing as packing_


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = corpus(spark, 120, seed=12)
    clash(docs).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (999_999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return dict(rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(sf, 'documents.parquet')}/*.parquet')")
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(rows(queries.QUERIES[name](spark, sf), *columns)) == sorted(result.fetchall())


def test_op1(spark, sf, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, places = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, crc, sequence, offset in rows(queries.op1_best_fit_packing(spark, sf), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        got[doc].append((piece, start, length, crc))
        places[sequence].append((offset, length))
    for doc, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert sorted(got[doc]) == [(i, 2048 * i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(cut)]
    for held in places.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(n for held in places.values() for _, n in held)
    lengths = [n for held in places.values() for _, n in held if n < 2048]
    assert len(places) <= 1.03 * -(-total // 2048) + 1 and packing_.best_plan(Counter(lengths))[1] <= len(places)


def test_op2(spark, sf, texts):
    """Every prediction again, text by text and window by window, with the network of the same fit."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.fit(docs)
    for doc, held, pred, score in rows(queries.op2_language_id(spark, sf), "doc_id", "held_out", "lang_pred", "score"):
        assert held == (zlib.crc32(str(doc).encode()) % 4 == 2)
        text = texts[doc]
        if not text or not langid.LETTER.search(text):
            assert (pred, score) == ("und", 0.0)
            continue
        raw, sums = text.encode(), np.zeros(len(net.languages))
        for at in range(0, len(raw), langid.WINDOW):
            x = np.frombuffer(raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8).astype(np.intp)[:, None]
            p = langid._softmax(langid._logits(net, [langid.run_direction(net.w[k], net.u[k], x, bool(k)) for k in range(2)]))
            sums += p[: len(raw) - at, :, 0].sum(axis=0)
        assert pred == net.languages[int(sums.argmax())] and score == pytest.approx(sums.max() / len(raw), abs=1e-4)


def test_op3(spark, sf, texts):
    for doc, n, chars, symbols, dup, repeat, failed, kept in rows(queries.op3_quality_rules(spark, sf), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"):
        t = texts[doc] or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        marked = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked))
        assert (n, chars, symbols, dup, repeat) == want
        assert failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (failed and kept)


def test_op6(spark, sf, texts):
    for doc, n, gone, places in rows(queries.op6_line_dedup(spark, sf), "doc_id", "n_lines", "n_removed", "removed"):
        lines = (texts[doc] or "").split("\n")
        assert n == sum(bool(words(x)) for x in lines) and gone == len(places) and all(words(lines[i]) for i in places)
        # what repeats an earlier line exactly goes in any case
        earlier = {x for d, t in texts.items() if d < doc for x in (t or "").split("\n")}
        for i, x in enumerate(lines):
            if words(x) and (x in earlier or x in lines[:i]):
                assert i in places


def test_op7(spark, sf, texts):
    got = rows(queries.op7_training_order(spark, sf), "doc_id", "piece", "slot", "crc32")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(s for *_, s, _ in got) == list(range(len(got)))
    crcs = {(d, p): c for d, p, _, c in got}
    for doc, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids
        padded = np.zeros((len(ids) // 256 + 1) * 256, "<u2")
        padded[: len(ids)] = ids
        assert [crcs[doc, i] for i in range(len(padded) // 256)] == [zlib.crc32(padded[i : i + 256].tobytes()) for i in range(0, len(padded), 256)]


def test_op8(spark, sf, texts):
    """Every span equals, normalised, the text at the place kept for it; every sentence that repeats is among the spans."""
    got = rows(queries.op8_substring_dedup(spark, sf), "doc_id", "start", "end", "kept_doc_id", "kept_start")
    for doc, a, b, kept, at in got:
        assert (kept, at) < (doc, a) and substrings.normalize(texts[kept][at:]).startswith(substrings.normalize(texts[doc][a:b]))
    spans, seen = {(d, a, b) for d, a, b, *_ in got}, set()
    for doc in sorted(texts):
        for m in substrings.UNITS["sentence"].finditer(texts[doc] or ""):
            unit = substrings.normalize(m[0])
            if len(unit.split()) >= substrings.MIN_WORDS:
                assert (unit in seen) == ((doc, m.start() + len(m[0]) - len(m[0].lstrip()), m.end()) in spans)
                seen.add(unit)


def test_op9(spark, sf, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for doc, size, n, over in rows(queries.op9_token_counts(spark, sf), "doc_id", "n_bytes", "n_tokens", "over_limit"):
        t = texts[doc] or ""
        assert (size, n, over) == (len(t.encode()), len(sp.encode(t)), n > 4096)
