"""Substring dedup by unit hashing: normalised units, digests grouped globally, the earliest occurrence kept.

Units are lines, paragraphs, or sentences within lines. Passages that are set into other texts seldom begin or end where a
line does, but the sentences inside them stay whole, so sentences are the default. Short units recur by chance; together with
their neighbours, as runs, they are as good as long ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where units end. A sentence ends at its stop before white space, or with its line.
UNITS = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]|\n(?!\s*\n))+"),
    "sentence": re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)"),
}
#: Shorter units are left alone, or taken as runs with their neighbours: by themselves they recur by chance.
MIN_WORDS = 8


def normalize(unit: str) -> str:
    """Lower case, blanks between words only."""
    return " ".join(unit.lower().split())


def _runs(counts: list[int], least: int) -> set[tuple[int, int]]:
    """``(first, last)`` of the shortest runs of two or more units with ``least`` words that start or end at each short unit.

    Whatever run of whole units with ``least`` words is repeated, each of its short units lies in one of these inside it.
    """
    out = set()
    n = len(counts)
    for i, c in enumerate(counts):
        if c >= least:
            continue
        j, total = i, c
        while total < least and j + 1 < n:
            j += 1
            total += counts[j]
        if total >= least:
            out.add((i, j))
        j, total = i, c
        while total < least and j > 0:
            j -= 1
            total += counts[j]
        if total >= least:
            out.add((j, i))
    return out


def units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """``h1, h2, doc_id, text_hash, start, end, n_words, own``: every unit of at least ``min_words``, by code-point offsets.

    text_hash: ``xxhash64`` of the whole text, which tells rows of one id (or none) apart.

    runs: shorter units too, each with as many neighbours as make up ``min_words``, as one span. own: start of the first equal span of
    the text if that reaches into this one, else its own start.
    """
    pattern = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mask = (1 << 63) - 1
        for b in batches:
            h1, h2, doc, whole, start, end, words, own = [], [], [], [], [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                spans, of_text = [], xxhash.xxh64_intdigest(text, 42)
                of_text -= of_text >> 63 << 64
                for m in pattern.finditer(text):
                    found = m[0].lower().split()
                    if found and (runs or len(found) >= min_words):
                        spans.append((" ".join(found), m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), len(found)))
                chosen = [x for x in spans if x[3] >= min_words]
                for i, j in _runs([x[3] for x in spans], min_words) if runs else ():
                    of = spans[i : j + 1]
                    chosen.append((" ".join(x[0] for x in of), of[0][1], of[-1][2], sum(x[3] for x in of)))
                seen: dict[int, tuple[int, int]] = {}
                for found, at, to, n in sorted(chosen, key=lambda x: x[1]):
                    x = xxhash.xxh3_128_intdigest(found)
                    h1.append(x & mask), h2.append((x >> 64) & mask), doc.append(d), whole.append(of_text), start.append(at), end.append(to), words.append(n)
                    began, ended = seen.setdefault(x, (at, to))
                    own.append(began if at < ended else at)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["h1", "h2", "doc_id", "text_hash", "start", "end", "n_words", "own"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((h1, h2, doc, whole, start, end, words, own), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "h1 long, h2 long, doc_id long, text_hash long, start long, end long, n_words int, own long")


def repeated_spans(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """``doc_id, start, end, n_words, kept_doc_id, kept_start, text_hash``: each unit that an earlier one equals, beside the earliest.

    Earliest by ``(doc_id, start)``, null ids last; texts that share an id, or have none, come in the order of ``text_hash``, by
    which ``remove_spans`` tells them apart. Offsets are code points of the original text. Repeats within a text count too.
    Rows that repeat as a whole (id and text) count as one. Null texts have no units.
    runs: units of under ``min_words`` are looked for as runs with their neighbours (spans may then overlap); a run that
    overlaps the earliest one itself is no repeat of it.
    """
    u = units(docs, unit, min_words, runs)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("start"))
    # summed map-side: a unit that makes up a third of all rows is a few rows of each task
    first = u.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    first = first.where("first <> last").select("h1", "h2", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), F.col("first.text_hash").alias("kept_hash"))
    later = ~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("text_hash") == F.col("kept_hash")) & (F.col("own") == F.col("kept_start")))
    return u.join(first, ["h1", "h2"]).where(later).select("doc_id", "start", "end", "n_words", "kept_doc_id", "kept_start", "text_hash")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with all spans cut out of their texts, other columns as they were.

    Spans belong to rows by id and ``text_hash``: rows without an id, and texts that share one, each lose their own.
    """
    columns = docs.columns
    cut = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cut"))
    text = F.concat(
        F.aggregate(
            "__cut",
            F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
            lambda a, s: F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))).alias("out"),
            ),
            lambda a: F.concat(a["out"], F.substr("text", (a["at"] + 1).cast("int"), F.char_length("text"))),
        )
    )
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    joined = docs.join(cut, mine, "left").withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(text))
    return joined.select(*columns)
