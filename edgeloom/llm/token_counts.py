"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies, and summed.

Pre-tokens are cut where no piece of the vocabulary can reach across: before a run of blanks, and around line breaks. So a
text's pieces are those of its pre-tokens, and no ids of texts are ever made.

Pre-token frequencies are heavy-tailed. The most frequent pre-tokens, a bounded number, reach every task as a broadcast
table and cover most of the text; only the rare rest of each document is shuffled to the full table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import release, stable

BLANK = "▁"
PRE_TOKEN = re.compile(f"\n|[ {BLANK}]+[^ {BLANK}\n]*|[^ {BLANK}\n]+")
#: Pre-tokens of the broadcast table at most, and bytes of one of them: longer ones are counted like rare ones.
FREQUENT = 1_000_000
FREQUENT_BYTES = 64
#: A task hands on its counts beyond so many distinct pre-tokens.
FLUSH = 300_000


class PieceCounter:
    """Pieces of pre-tokens under a sentencepiece model that marks blanks in front and adds one to a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError("the vocabulary has pieces that reach across pre-tokens")
        (self.line,) = {len(x) for x in self.model.encode(["\n"])}  # the blank in front, and the line break

    def count(self, tokens: list[str]) -> list[int]:
        # the model puts a blank in front itself: take one off, or shield a token without one by a line break
        ask = [t[1:] if t[0] in (" ", BLANK) else "\n" + t for t in tokens]
        out = []
        for t, ids in zip(tokens, self.model.encode(ask, num_threads=1), strict=True):
            if t == "\n":
                out.append(self.line - 1)
            elif t in (" ", BLANK):
                out.append(1)
            else:
                out.append(len(ids) if t[0] in (" ", BLANK) else len(ids) - self.line)
        return out


_COUNTERS: dict[str, PieceCounter] = {}
_TABLES: dict[str, dict[str, int]] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKEN.findall(" " + text) if text else []


def vocabulary(docs: DataFrame, model: str) -> DataFrame:
    """``token, freq, pieces`` of every distinct pre-token."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "freq"])

        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(pre_tokens(text))
                if len(counts) >= FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for b in batches:
            pieces = counter.count(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.int64())], names=["token", "freq", "pieces"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(tally, "token string, freq long")
    return counted.groupBy("token").agg(F.sum("freq").alias("freq")).mapInArrow(encode, "token string, freq long, pieces long")


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row. A null text is empty and has no tokens; ids are only carried."""
    spark = docs.sparkSession
    table = stable(vocabulary(docs, model))
    release(spark, at_once=True)  # the shuffle of the partial counts
    top = table.where(F.octet_length("token") <= FREQUENT_BYTES).orderBy(F.desc("freq"), "token").limit(frequent).select("token", "pieces").toArrow()
    ident = uuid.uuid4().hex  # names the table in workers that serve several calls
    known = spark.sparkContext.broadcast((top["token"].to_pylist(), top["pieces"].to_pylist()))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("key"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ident not in _TABLES:
            _TABLES.clear()
            _TABLES[ident] = dict(zip(*known.value, strict=True))
        get = _TABLES[ident].get
        for b in batches:
            key, doc, size, token, n = [], [], [], [], []
            for d, text, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                items = pre_tokens(text)
                found = list(map(get, items))
                rare = Counter(t for t, f in zip(items, found, strict=True) if f is None) if None in found else {}
                # the row of the document itself, under a name that is no pre-token and spreads over partitions
                key.append(k), doc.append(d), size.append(len(text.encode()) if text else 0), token.append(f"\n{k}"), n.append(sum(filter(None, found)))
                for t, c in rare.items():
                    key.append(k), doc.append(None), size.append(None), token.append(t), n.append(c)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((key, doc, size, token, n), types, strict=True)], names=["key", "doc_id", "n_bytes", "token", "n"])

    parts = rows.mapInArrow(split, "key long, doc_id long, n_bytes long, token string, n long")
    joined = parts.join(table.select("token", "pieces"), "token", "left")
    n = F.col("n") * F.coalesce("pieces", F.lit(1))
    per = joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(n).alias("n_tokens"))
    return per.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
