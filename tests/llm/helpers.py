"""Small tables with awkward rows, and brute force for words and shingles."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def shingles(text, k=5, fold=True):
    w = words(lower(text) if fold else text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


AWKWARD = [None, "", " ", "\n\n", "x", "one two three four", "Ünïcödé ﬁ 日本語 テキスト 🎉", "a\tb\x0bc\x0cd\re", "12 !? ..", "same line\nsame line\nsame line\n", "<|endoftext|> don't we'll", "ΟΔΟΣ. é́   \x85 \xa0x"]


def corpus(spark, n=120, seed=1, extra=()):
    """Random prose with exact and near copies, awkward texts, null and repeated ids and rows, and clashing extra columns."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([3, 8, 30, 80, 200]))
        if rows and rng.random() < 0.25:
            text = rng.choice(rows)[1]
            if rng.random() < 0.7:
                w = text.split(" ")
                w[rng.randrange(len(w))] = "edited"
                text = " ".join(w)
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])))
    rows += [(1000 + i, t, None, "b") for i, t in enumerate(AWKWARD)]
    rows += [(2000, "long " * 30_000 + "end", "en", "z"), *extra]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)


def clash(df):
    """The same rows beside columns named like operators' own."""
    from pyspark.sql import functions as F

    for name in ("words", "size", "n", "key", "component", "component_id", "length", "block", "node", "first", "line", "score", "token", "range", "tie"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
